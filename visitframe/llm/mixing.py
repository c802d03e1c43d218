"""Mixing of sources to target weights by Pareto order sampling.

A source that is to give more than all its words gives every document its whole copies for certain. What is
left is a sample without replacement and with unequal inclusion probabilities: each document draws
U from a keyed hash, documents are ranked by odds(U) / odds(inclusion probability), and the sample is the
ranking's head whose words come nearest to what the source still owes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, masked, settle

#: Measures are summed in whole millionths, so that reruns agree to the last bit.
MICRO = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Sources in code point order, null last, weigh `weights` in turn and share the total; a target stops at
    `cap` times its source's size and the excess is shared again by weight. The sources with the least
    cap-to-weight ratio fill up first, so one running sum over sources finds all that stop.
    Sources of size zero get zero; an empty table gives no rows.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weighed = (sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
               .withColumn("room", (F.col("source_size") * cap).cast("double"))
               .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("room"))
    filled = filled.withColumn("place", F.row_number().over(by_ratio))
    # the level at the first source that does not fill up holds for all after it
    first = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(Window.partitionBy())
    open_ = filled.withColumn("first", first)
    return open_.select("source", "source_size", F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight"))
                        .otherwise(F.col("room")).alias("target"))


def uniform(*cols: Column, seed: int) -> Column:
    """A keyed number inside (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double")
    return (bits + 0.5) / float(1 << 52)


def pareto_mix(items: DataFrame, targets: DataFrame, tilt: float = 0.5, seed: int = 11, bins: int = 4096) -> DataFrame:
    """Copies of each item (doc_id, source, size, measure) so that each source's words come near its target.

    With ratio = target / source_size, every item gets floor(ratio) copies. The rest f of the ratio is the mean
    inclusion probability; an item's own is f + tilt * min(f, 1 - f) * (measure - the source's word-weighted mean
    measure), with measures in [0, 1], which keeps the expected words at f times the source's. Ranks are cut in
    two rounds of `bins` ranges whose words are summed first, so only the rows of one range in bins * bins of a
    source are ever ordered together. The cut is the rank nearest to the target, at most half a document away.

    Null doc_ids are items like any other, repeated rows are items of their own, items of size zero get the
    certain copies only. Adds ratio, inclusion, rank_odds and copies.
    """
    mean = items.groupBy("source").agg(
        F.coalesce(F.try_divide(F.sum(F.round(F.col("measure") * MICRO).cast("long") * F.col("size")), F.sum("size")) / MICRO, F.lit(0.0)).alias("mean_measure"))
    plan = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).drop(mean["source"])
    plan = settle(plan.select("source", "source_size", "target", "mean_measure"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    f = F.col("ratio") - F.floor("ratio")
    odds = lambda p: p / (1 - p)
    drawn = uniform(F.col("doc_id"), F.col("size"), seed=seed)
    rows = (attach(items, plan, ["source"]).withColumn("ratio", ratio)
            .withColumn("inclusion", f + tilt * F.least(f, 1 - f) * (F.col("measure") - F.col("mean_measure")))
            .withColumn("rank_odds", F.when((F.col("inclusion") > 0) & (F.col("size") > 0),
                                            odds(drawn) / odds(F.col("inclusion"))))
            .withColumn("owed", F.col("target") - F.floor("ratio") * F.col("source_size")))
    place = F.col("rank_odds") / (1 + F.col("rank_odds")) * bins
    rows = rows.withColumn("bin1", F.least(F.floor(place), F.lit(bins - 1)).cast("int"))
    rows = rows.withColumn("bin2", F.least(F.floor((place - F.col("bin1")) * bins), F.lit(bins - 1)).cast("int"))
    rows = rows.withColumn("plain_ratio", F.col("ratio"))

    def cut(table, bin_, left):
        """Per source the range in which the running words pass what is owed, and the words before it."""
        sums = table.filter(F.col(bin_).isNotNull()).groupBy("source", bin_).agg(
            F.sum("size").alias("words"), F.first(left).alias("left"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy(bin_))
        edge = sums.withColumn("upto", run).filter((F.col("upto") >= F.col("left")))
        return edge.groupBy("source").agg(F.min(F.struct(bin_, (F.col("upto") - F.col("words")).alias("before"))).alias("e"))

    one = settle(cut(rows, "bin1", "owed").select("source", F.col("e.bin1").alias("cut1"), F.col("e.before").alias("before1")))
    rows = attach(rows, one, ["source"])
    inside = rows.filter(F.col("bin1") == F.col("cut1")).withColumn("left2", F.col("owed") - F.col("before1"))
    two = settle(cut(inside, "bin2", "left2").select("source", F.col("e.bin2").alias("cut2"), F.col("e.before").alias("before2")))
    rows = attach(rows, two, ["source"])
    edge = (F.col("bin1") == F.col("cut1")) & (F.col("bin2") == F.col("cut2"))
    by_rank = Window.partitionBy("source").orderBy("rank_odds", "doc_id", "size")
    last = rows.filter(edge).withColumn("upto", F.sum("size").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    left3 = F.col("owed") - F.col("before1") - F.col("before2")
    # nearest: the row is in if taking it leaves the sum nearer than leaving it out
    last = last.withColumn("extra", (F.col("upto") - F.col("size") / 2.0 <= left3).cast("int")).drop("upto")
    head = (F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))
    # no cut: the whole source does not reach what is owed
    rest = rows.filter(~F.coalesce(edge, F.lit(False))).withColumn(
        "extra", F.when(F.col("rank_odds").isNull() | (F.col("owed") <= 0), 0)
        .when(F.col("cut1").isNull(), 1).otherwise(F.coalesce(head, F.lit(False)).cast("int")))
    whole = F.floor("plain_ratio").cast("long")
    return (rest.unionByName(last).withColumn("copies", whole + F.col("extra"))
            .drop("bin1", "bin2", "cut1", "before1", "cut2", "before2", "extra", "owed", "plain_ratio"))


def _measure(size: Column) -> Column:
    return F.least(F.log2(size + 1.0) / 16, F.lit(1.0))


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: int = 11) -> DataFrame:
    """Mix documents (doc_id, text, source): sizes are words, and longer documents are a little likelier.

    Returns doc_id, source, size, source_size, target, ratio, inclusion, rank_odds, copies and mean_measure.
    A null text has size 0; a null source is a source of its own, the last.
    """
    thin = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, cap))
    return pareto_mix(thin.withColumn("measure", _measure(F.col("size"))), targets, seed=seed).drop("measure")


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: int = 11) -> DataFrame:
    """Each document as often as mix() takes it, all columns as they were; nothing is shuffled but sizes.

    A source's sample is known by its last rank, so each document finds its copies where it lies. Rows of the last rank's
    very doc_id and size are taken together. A document of size zero comes floor(ratio) times, once at least: it costs no words.
    """
    docs, back = masked(docs, ("doc_id", "text", "source"))
    mixed = mix(docs, weights, cap, seed)
    whole = F.floor("ratio")
    last = F.max(F.when(F.col("copies") > whole, F.struct("rank_odds", "doc_id", "size")))
    plan = settle(mixed.groupBy("source").agg(F.max("ratio").alias("_ratio"), F.first("mean_measure").alias("_mean"), last.alias("_last")))
    tilt = 0.5
    f = F.col("_ratio") - F.floor("_ratio")
    odds = lambda p: p / (1 - p)
    rows = attach(docs.withColumn("_size", word_count(F.col("text"))), plan, ["source"])
    rows = rows.withColumn("_inclusion", f + tilt * F.least(f, 1 - f) * (_measure(F.col("_size")) - F.col("_mean")))
    rank = odds(uniform(F.col("doc_id").cast("long"), F.col("_size"), seed=seed)) / odds(F.col("_inclusion"))
    mine = F.struct(rank.alias("rank_odds"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"))
    taken = (F.col("_inclusion") > 0) & (F.col("_size") > 0) & F.col("_last").isNotNull() & (mine <= F.col("_last"))
    copies = F.floor("_ratio") + F.coalesce(taken, F.lit(False)).cast("long")
    copies = F.when(F.col("_size") == 0, F.greatest(copies, F.lit(1))).otherwise(copies)
    return back(rows.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))


def op1_pareto_mix(spark, folder) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies", "inclusion")
