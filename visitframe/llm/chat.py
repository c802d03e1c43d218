"""Chat formatting: a dialogue seen by each of its speakers, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place: rows numbered from 0 in each conversation by turn, role and text.

    Equal rows are counted first and follow each other. Rows are sorted over ranges that any conversation may span, numbered inside each
    range, and a range that goes on with a conversation adds what the ranges before hold of it, so no conversation meets in one task.
    """
    equal = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    ranged = settle(equal.orderBy("conv_id", "turn", "role", "text").withColumn("range", F.spark_partition_id()))
    held = ranged.groupBy("conv_id", "range").agg(F.sum("times").alias("rows"))
    spread = held.join(held.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id"), "conv_id")
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("rows")
    offsets = settle(spread.select("conv_id", "range", before.alias("before")).filter("before > 0"))
    inside = F.sum("times").over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")
    rows = attach(ranged.withColumn("inside", inside), offsets, ["conv_id", "range"]).withColumn("first", F.col("inside") + F.coalesce("before", F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)).alias("place"))


def rotate(turns: DataFrame, part_turns: int = 512) -> DataFrame:
    """conv_id, part, speaker, n_turns, char_start, system, text, spans: every speaker's view of each whole conversation of turns (conv_id, turn, role, text).

    In a speaker's view their own turns are the assistant's, those of role system stay the system's, and others are
    users with their name. spans holds [start, end) characters of the text that are to be learned: the
    assistant's words and closing mark. A conversation of over `part_turns` turns comes in parts of that many, each of them for everyone who speaks
    anywhere in it: the parts' texts one after another are the whole view, char_start says where a part begins in it, and
    system is the last system turn before the part. System alone has no view. Repeated rows are turns of their own; a turn number used
    twice sorts by role, then text. A null turn counts as 0, a null role is the speaker unknown, a null text is empty. Rows without a
    conversation are left out; other columns are ignored. A text of any length stays whole.
    """
    clean = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = placed(clean).withColumn("part", F.floor(F.col("place") / part_turns).cast("long"))
    whole = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    said = F.filter("turns", lambda t: t["role"] == "system")
    own = whole.select("conv_id", "part", F.when(F.size(said) > 0, F.element_at(said, -1)["text"]).alias("said"))
    by = Window.partitionBy("conv_id").orderBy("part")
    carried = settle(own.withColumn("system", F.last("said", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
                     .withColumn("last", F.max("part").over(Window.partitionBy("conv_id"))).filter(F.col("last") > 0).select("conv_id", "part", "system", "last"))
    speakers = clean.filter(F.col("role") != "system").select("conv_id", F.col("role").alias("speaker")).distinct()
    views = attach(whole, carried, ["conv_id", "part"]).join(speakers, "conv_id")

    def segment(t: Column) -> Column:
        head = (F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"] == "system", F.lit("system"))
                 .otherwise(F.concat(F.lit("user name="), t["role"])))
        return F.struct(F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"),
                        (t["role"] == F.col("speaker")).alias("own"))

    views = views.withColumn("segments", F.transform("turns", segment))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + F.length(s["head"])
        b = a + F.length(s["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + 1).alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    views = views.select("conv_id", "part", "speaker", F.size("turns").cast("long").alias("n_turns"), "system", "last", text.alias("text"),
                         F.aggregate("segments", start, step)["spans"].alias("spans"))
    # only conversations of several parts are brought together to add up their lengths
    long = views.filter(F.col("last").isNotNull())
    sized = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(long.select("conv_id", "part", "speaker", F.coalesce(F.sum(F.length("text").cast("long")).over(sized), F.lit(0)).alias("char_start")))
    views = attach(views, starts, ["conv_id", "part", "speaker"]).withColumn("char_start", F.coalesce("char_start", F.lit(0)).cast("long"))
    return views.select("conv_id", "part", "speaker", "n_turns", "char_start", "system", "text", "spans")


def op4_chat_views(spark, folder) -> DataFrame:
    views = rotate(spark.read.parquet(f"{folder}/conversations.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.select("conv_id", "part", "speaker", "n_turns", "char_start", "system", "text", spans.alias("spans"), F.size("spans").cast("long").alias("n_spans"))


OP4_SQL = f"""
WITH clean AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM clean WHERE role <> 'system'),
segments AS (
  SELECT v.conv_id, place // 512 AS part, speaker, place, role, text, role = speaker AS own,
         '{OPEN}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
         text || '{CLOSE}' AS body
  FROM speakers v JOIN clean c ON v.conv_id = c.conv_id),
spots AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
              PARTITION BY conv_id, part, speaker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM segments),
views AS (
  SELECT conv_id, part, speaker, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
         coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS spans,
         count(*) FILTER (own) AS n_spans
  FROM spots GROUP BY 1, 2, 3)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
  (SELECT arg_max(c.text, c.place) FROM clean c WHERE c.conv_id = views.conv_id AND c.role = 'system' AND c.place < views.part * 512) AS system
FROM views
"""
