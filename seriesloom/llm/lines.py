"""Line dedup by site-relative frequency: lines that stand on too large a part of a host's pages go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import saved, unused

RATIO = 0.08
MIN_PAGES = 5
#: (least characters, ratio): a line that long is not repeated by chance, so a smaller part of the host marks it.
LONG_RATIOS = ((20, 0.005), (100, 0.001))
#: The frequent lines of all hosts together are broadcast up to this number (49 bytes each), else joined.
BROADCAST_LINES = 200_000


def frequent_lines(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, long_ratios=()) -> DataFrame:
    """(site string, flags array<string>, with ``long_ratios`` also often array<string>, those above ``ratio``): MD5 of the lines on more than ``ratio`` of a host's pages, a row per host that has any.

    ``long_ratios``: (least characters, ratio) in ascending order, for longer lines.
    A line is trimmed of spaces; empty lines do not count.  Pages of one host with equal text are
    one page.  At most (mean lines of a page) / ratio lines of a host can qualify, whatever its size.
    """
    key, limit = (lambda l: F.md5(F.trim(l))), F.lit(ratio)
    if long_ratios:  # the key's last character tells which ratio applies
        kind = lambda l: sum((F.when(F.length(F.trim(l)) >= n, 1).otherwise(0) for n, _ in long_ratios), F.lit(0))
        key = lambda l: F.concat(F.md5(F.trim(l)), kind(l).cast("string"))
        limit = F.element_at(F.array(*[F.lit(r) for r in (ratio, *[r for _, r in long_ratios])]), F.substring("key", 33, 1).cast("int") + 1)
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda l: F.trim(l) != ""), key))
    rows = pages.select(F.col(host_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    distinct = rows.select("site", F.md5("text").alias("page"), keys.alias("keys")).dropDuplicates(["site", "page"])
    # the empty key stands for the page itself, so that one aggregation also gives the host's total
    every = distinct.select("site", F.explode(F.concat(F.array(F.lit("")), F.coalesce("keys", F.array().cast("array<string>")))).alias("key"))
    counts = saved(every.groupBy("site", "key").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | (F.col("key") == "")), "line-counts")
    totals = counts.where("key = ''").select(F.col("site").alias("host"), F.col("n").alias("total"))
    found = counts.where("key != ''").join(totals, F.col("site").eqNullSafe(F.col("host"))).where(F.col("n") > limit * F.col("total"))
    md5 = F.substring("key", 1, 32)
    more = [F.collect_set(F.when(F.col("n") > ratio * F.col("total"), md5)).alias("often")] if long_ratios else []
    return found.groupBy("site").agg(F.collect_set(md5).alias("flags"), *more)


def drop_site_lines(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    dropped_col: str | None = None, long_ratios=(),
) -> DataFrame:
    """``pages`` without the lines that stand on at least ``min_pages`` and more than ``ratio`` of their host's pages.

    ``long_ratios``: (least characters, ratio) in ascending order; a line takes the last that it reaches.
    A page that would lose more than half of its text to them is likely one of several near copies,
    whose lines are its content: it loses only the lines above ``ratio``.

    All rows, columns and other lines stay, in order; ``dropped_col`` adds the number of lines
    that went.  Lines are compared without the spaces around them.  Only one hash per line and
    page is shuffled; texts stay where they are unless the frequent lines are too many to
    broadcast, and then the join splits a host that holds many rows.

    Null host: a host of its own.  Null text: stays null, counts as one page.  Empty lines are
    never dropped.  A page that holds frequent lines only becomes empty.  Copies of a page on its
    host count once and are all cleaned; repeated rows stay repeated.  Empty table: no rows.
    Extra columns pass through whatever their names.
    """
    flags = saved(frequent_lines(pages, host_col, text_col, ratio, min_pages, long_ratios), "frequent-lines")
    site, marks, hits, often = (unused(x, pages) for x in ("site", "flags", "hits", "often"))
    flags = flags.select(F.col("site").alias(site), F.col("flags").alias(marks), *([F.col("often").alias(often)] if long_ratios else []))
    if (flags.agg(F.sum(F.size(marks))).first()[0] or 0) <= BROADCAST_LINES:
        flags = F.broadcast(flags)
    key = lambda l: F.md5(F.trim(l))
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    joined = pages.join(flags, F.col(host_col).cast("string").eqNullSafe(F.col(site)), "left")
    joined = joined.withColumn(hits, F.when(F.col(marks).isNotNull(), F.array_intersect(F.transform(lines, key), marks)))
    if long_ratios:
        left = F.filter(lines, lambda l: ~F.array_contains(hits, key(l)))
        whole = F.when(F.size(hits) == 0, True).otherwise(2 * F.length(F.array_join(left, "\n")) >= F.length(F.array_join(lines, "\n")))
        joined = joined.withColumn(hits, F.when(whole, F.col(hits)).otherwise(F.array_intersect(hits, often)))
    found = F.coalesce(F.size(hits) > 0, F.lit(False))
    stays = F.filter(lines, lambda l: ~F.array_contains(hits, key(l)))
    out = {text_col: F.when(found, F.array_join(stays, "\n")).otherwise(F.col(text_col))}
    if dropped_col:
        out[dropped_col] = F.when(found, F.size(lines) - F.size(stays)).otherwise(0).cast("long")
    return joined.withColumns(out).drop(site, marks, hits, often)


def op3_site_lines(spark, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines, and how many went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_site_lines(docs, dropped_col="dropped", long_ratios=LONG_RATIOS).select("doc_id", "source", "text", "dropped")


OP3_SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')))) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n, CASE {' '.join(f"WHEN length(line) >= {n} THEN {r}" for n, r in reversed(LONG_RATIOS))} ELSE {RATIO} END AS ratio
  FROM lines WHERE line <> '' GROUP BY source, line),
flags AS (SELECT c.source, list(c.line) AS marks, list(c.line) FILTER (c.n > {RATIO} * t.total) AS often FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > c.ratio * t.total GROUP BY c.source),
split AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS lines, f.marks, coalesce(f.often, []) AS often
  FROM documents d LEFT JOIN flags f ON d.source IS NOT DISTINCT FROM f.source),
tried AS (SELECT *, list_filter(lines, lambda l: NOT list_contains(marks, trim(l, ' '))) AS rest FROM split),
kept AS (SELECT *, CASE WHEN 2 * length(coalesce(array_to_string(rest, chr(10)), '')) >= length(text) THEN rest
  ELSE list_filter(lines, lambda l: NOT list_contains(often, trim(l, ' '))) END AS stays FROM tried)
SELECT doc_id, source,
  CASE WHEN marks IS NULL OR text IS NULL THEN text ELSE coalesce(array_to_string(stays, chr(10)), '') END AS text,
  CASE WHEN marks IS NULL OR text IS NULL THEN 0 ELSE len(lines) - len(stays) END AS dropped FROM kept
"""
