"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a site when the pages of the site that hold it are more than a ratio of all its pages.
A site's boilerplate list is bounded by (mean lines per page) / ratio, so it travels as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, fresh, masked, settle, settle_table

BLANKS = " \t\r"
#: Elements that end a line of text.
BLOCKS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|"
          "ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul")
HIDDEN = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, null where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def visible_text(html: Column) -> Column:
    """Text of a page, a line per block element; scripts, styles and comments left out, entities as they are."""
    shown = F.regexp_replace(html, HIDDEN, " ")
    broken = F.regexp_replace(shown, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(broken, "<[^>]*>", "")


def _marks(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.unhex(F.md5(F.btrim(x, F.lit(BLANKS)))))


def drop_site_lines(docs: DataFrame, site: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """docs with `text` without boilerplate lines, and n_lines, n_dropped; all other columns as they were.

    Lines are compared without blanks around them; lines of blanks only are kept and not counted. A line goes if more than `ratio`
    of its site's pages and at least `least_pages` hold it; how often one page repeats it does not count. Rows without a site keep
    all lines. A null text stays null with no lines; a text whose lines all go becomes empty. Repeated rows are pages. Where docs
    has a column n_lines or n_dropped, the new one gets underscores before its name.
    """
    counted = [fresh(c, docs) for c in ("n_lines", "n_dropped")]
    plain, _ = masked(docs, ())
    at = dict(zip(docs.columns, plain.columns))
    out = _without_site_lines(plain, at[site], at[text], ratio, least_pages)
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("n_lines", "n_dropped"), counted)])


def _without_site_lines(docs: DataFrame, site: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    used = {site, text}
    lines = F.split(F.col(text), "\n")
    filled = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    pages = docs.select(F.col(site).alias("_site"), filled.alias("_lines")).filter(F.col("_site").isNotNull())
    totals = settle(pages.groupBy("_site").agg(F.count("*").alias("_pages")))
    each = pages.select("_site", F.explode(F.array_distinct(_marks(F.col("_lines")))).alias("_mark"))
    held = each.groupBy("_site", "_mark").agg(F.count("*").alias("_held")).filter(F.col("_held") >= least_pages)
    common = attach(held, totals, ["_site"]).filter(F.col("_held") > F.col("_pages") * ratio)
    lists = settle(common.groupBy("_site").agg(F.collect_list("_mark").alias("_common")))
    keep = [c for c in docs.columns if c not in used]
    tagged = docs.select(*keep, F.col(site), F.col(text), F.col(site).alias("_site"))
    tagged = attach(tagged, lists, ["_site"])
    stays = F.filter(F.split(F.col(text), "\n"), lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col("_common"), F.unhex(F.md5(F.btrim(x, F.lit(BLANKS))))))
    full = lambda a: F.size(F.filter(a, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    out = tagged.withColumn("_kept", F.when(F.col("_common").isNull(), F.split(F.col(text), "\n")).otherwise(stays))
    n = F.coalesce(F.when(F.col(text).isNotNull(), full(F.split(F.col(text), "\n"))), F.lit(0))
    out = (out.withColumn("n_lines", n.cast("long"))
              .withColumn("n_dropped", n - F.coalesce(F.when(F.col(text).isNotNull(), full(F.col("_kept"))), F.lit(0)).cast("long")))
    out = out.withColumn(text, F.when(F.col("_common").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")))
    return out.select(*docs.columns, "n_lines", "n_dropped")


def op6_site_line_dedup(spark, folder, ratio: float = 0.015, least_pages: int = 3) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    # the patterns are the work here, and the lines are read three times
    shown = settle_table(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_text(F.col("html")).alias("text")))
    return drop_site_lines(shown, "host", "text", ratio, least_pages)


OP6_SQL = rf"""
WITH shown AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'),
                        '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text,
         row_number() OVER () AS row
  FROM pages),
lines AS (
  SELECT row, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM shown),
held AS (
  SELECT host, trim(line, ' ' || chr(9) || chr(13)) AS line, count(DISTINCT row) AS n FROM lines
  WHERE host IS NOT NULL AND trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2),
common AS (
  SELECT host, line FROM held JOIN (SELECT host, count(*) AS pages FROM shown GROUP BY 1) USING (host) WHERE n >= 3 AND n > pages * 0.015::DOUBLE),
marked AS (
  SELECT l.row, l.line, l.place, c.line IS NOT NULL AS goes, trim(l.line, ' ' || chr(9) || chr(13)) <> '' AS filled
  FROM lines l LEFT JOIN common c ON l.host = c.host AND trim(l.line, ' ' || chr(9) || chr(13)) = c.line),
kept AS (
  SELECT row, string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes) AS text,
         count(*) FILTER (filled) AS n_lines, count(*) FILTER (goes) AS n_dropped FROM marked GROUP BY 1)
SELECT page_id, host, CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM shown s LEFT JOIN kept k USING (row)
"""
