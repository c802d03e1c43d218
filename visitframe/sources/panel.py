"""Reading, writing and deriving wide panels."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitframe.spec import PANEL, PanelSpec


def panel_schema(spec: PanelSpec = PANEL) -> T.StructType:
    kinds = {"EDU": T.StringType(), **{c: T.DoubleType() for c in ("AGE", "BMI", "INKOMEN")}}
    fields = [T.StructField(spec.id, T.LongType())]
    fields += [T.StructField(c, kinds.get(c, T.IntegerType())) for c in spec.covariates]
    fields += [T.StructField(c, T.DoubleType()) for c in spec.all_visit_columns()]
    return T.StructType(fields)


def read_panel(spark: SparkSession, path: str, spec: PanelSpec = PANEL, format: str = "parquet") -> DataFrame:
    """Load a wide panel from Parquet or CSV under the declared schema; NaN becomes NULL."""
    reader = spark.read.schema(panel_schema(spec))
    if format == "csv":
        reader = reader.option("header", True)
    df = reader.format(format).load(path)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result table as Parquet or as CSV with a header."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: the four outcome families by year 1995-2001, from one aggregate.

    The conditional aggregates combine map-side, so a customer holding a large share of
    all orders still reaches the reducers as one row per map task.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .filter((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
                & (F.col("o_orderdate") < F.lit("2002-01-01").cast("timestamp")))
        .select("o_custkey", "o_totalprice", (F.year("o_orderdate") - 1995).alias("t"))
    )
    aggs = []
    for t in PANEL.visits:
        price = F.when(F.col("t") == t, F.col("o_totalprice"))
        n = F.count(price)
        aggs += [
            (F.max(price) / 25000.0).alias(f"cdrsb{t}"),
            (F.avg(price) / 10000.0).alias(f"bprs{t}"),
            (F.min(price) / 100000.0).alias(f"abpet{t}"),
            F.when(n > 0, n.cast("double")).alias(f"taupet{t}"),
        ]
    return orders.groupBy("o_custkey").agg(*aggs)


def customer_panel(spark: SparkSession, sf_dir: str, monotone: bool = False) -> DataFrame:
    """The wide panel of customers over seven order years (gaps kept, or made monotone)."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    key = F.col("c_custkey")
    covariates = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("PATID"),
        F.col("n_regionkey").cast("int").alias("TRIAL"),
        (key % 2).cast("int").alias("SEX"),
        (55.0 + (F.col("c_acctbal") + 1000.0) / 400.0).alias("AGE"),
        F.col("c_mktsegment").alias("EDU"),
        (18.0 + 0.6 * F.col("c_nationkey")).alias("BMI"),
        (1000.0 + 25.0 * (key % 97)).alias("INKOMEN"),
        (F.floor(key / 2) % 2).cast("int").alias("JOB"),
        (1 + 2 * ((key * 7) % 11)).cast("int").alias("ADL"),
        (F.col("c_acctbal") < 0).cast("int").alias("WZC"),
    )
    cells = order_cells(spark, sf_dir)
    panel = covariates.join(cells, F.col("PATID") == F.col("o_custkey"), "left").drop("o_custkey")
    panel = panel.select("PATID", *PANEL.covariates, *PANEL.all_visit_columns())
    return make_monotone(panel) if monotone else panel


def make_monotone(panel: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Keep subjects seen at the first visit; blank everything after the first gap."""
    lead = spec.families[0]
    seen = {}
    for i, t in enumerate(spec.visits):
        upto = [F.col(f"{lead}{s}") for s in spec.visits[: i + 1]]
        every = F.lit(True)
        for c in upto:
            every = every & c.isNotNull()
        seen[t] = every
    out = panel.filter(F.col(f"{lead}{spec.visits[0]}").isNotNull())
    kept = [F.when(seen[t], F.col(f"{f}{t}")).alias(f"{f}{t}") for f in spec.families for t in spec.visits]
    return out.select(spec.id, *spec.covariates, *kept)


def stage(df: DataFrame, id: str = PANEL.id, small_bytes: int = 8 << 20) -> DataFrame:
    """Keep a table that several passes will read, spilling to disk.

    A table measured to be small for the number of cores is spread over them, since the fits are bound
    by arithmetic; a large one keeps the partitioning it has.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * small_bytes or held.rdd.getNumPartitions() >= cores:
        return held
    spread = held.repartition(cores, id).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    return spread
