"""Panel data with missing visits, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel with the job, so a cluster needs no
# separate install of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
