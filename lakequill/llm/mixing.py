"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Sources, ordered by code point with null last, have weights that repeat over them, and share a multiple of all words by
these weights; a source at its cap of repeats hands the excess on. A document is taken as many times as its source is
wanted in whole, and once more if its hash is below its source's threshold. Thresholds are found without a sort: words
are summed by source and the first 12 of the hash's 36 bits, the bucket that crosses the budget is found, and only its
rows are summed again by the next 12 bits, then by the last. The threshold is the largest with which the words below
it stay within the budget, so a mix misses its target by less than a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
#: The mix's words are this share of all, in hundredths.
PERCENT = 150
#: How often a document may be taken.
REPEATS = 2
_BITS, _LEVELS = 12, 3


def hashed(doc_id: Column, text: Column) -> Column:
    """36 bits of the md5 of id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 9), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), h (hash)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), hashed(F.col("doc_id"), F.col("text")).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: a row for each source."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        cases = F.when(F.col("place") % len(weights) == i, F.lit(w)).otherwise(cases)
    per = per.withColumn("place", place).withColumn("w", cases.cast("long"))
    cap = F.col("source_size") * repeats
    every = Window.orderBy(F.col("source_size") / F.col("w"), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # hundredths of words, and weights, left once the sources that reach their caps sooner have theirs
    left = F.sum("source_size").over(whole) * percent - F.coalesce(F.sum(cap).over(before), F.lit(0)) * 100
    per = per.withColumn("left", left).withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("full", cap * 100 * F.col("w_left") <= F.col("left") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("left").cast("double") / (F.col("w_left") * 100))).over(whole)
    return per.select("source", "source_size", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("w") * level).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """wanted with whole (times that every document is taken) and threshold (hashes below it are taken once more)."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.lit(0)
    for k in range(1, repeats + 1):
        whole = F.when(target >= size * k, F.lit(k)).otherwise(whole)
    wanted = wanted.withColumn("whole", whole).withColumn("budget", target - F.col("whole") * size)
    found = wanted.select("source", "budget", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("low"))
    for level in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - level)
        named = found.select(F.col("source").alias("s"), "budget", "base", "low")
        near = rows
        if level:
            # rows of the bucket on the boundary alone
            edge = found.select(F.col("source").alias("s"), F.col("low").alias("l"))
            near = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") >= F.col("l")) & (F.col("h") < F.col("l") + F.lit(1 << (shift + _BITS))), "left_semi")
        sums = near.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")).alias("run")
        sums = sums.select("source", "bucket", "n", run).join(named, F.col("source").eqNullSafe(F.col("s")))
        # the first bucket with which the words exceed the budget, and the words before it
        over = sums.where(F.col("base") + F.col("run") > F.col("budget")).groupBy("s").agg(F.min("bucket").alias("b"), F.min_by(F.col("base") + F.col("run") - F.col("n"), "bucket").alias("before"))
        over = over.withColumnRenamed("s", "o")
        found = found.join(over, F.col("source").eqNullSafe(F.col("o")), "left").select(
            "source", "budget",
            F.coalesce("before", "base").alias("base"),
            # without such a bucket, which only the first level lacks, all are below
            F.coalesce(F.shiftleft("b", shift), F.when(F.lit(level == 0), F.lit(1 << (_BITS * _LEVELS))).otherwise(F.col("low"))).alias("low"),
        )
        found = common.stored(found, "thresholds", 1)
    end = found.select(F.col("source").alias("s"), F.col("low").alias("threshold"))
    return wanted.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, times for every row of docs(doc_id, text, source).

    A null text has no words. A null source is a source of its own. Rows with the same id and text have the same hash,
    so they are taken alike. A source without words has the target 0. Reruns agree. Other columns are not looked at.
    """
    rows = common.kept(sized(docs))
    plan = common.stored(thresholds(rows, common.stored(targets(rows, weights, percent, repeats), "targets", 1), repeats), "plan", 1)
    plan = plan.withColumnRenamed("source", "s")
    times = (F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")).cast("int")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all its columns as they are, whatever their names.

    Null texts have no words and a null source is one of its own, as in mixed(); an empty table stays empty.
    """
    rows = common.kept(sized(docs))
    plan = common.stored(thresholds(rows, common.stored(targets(rows, weights, percent, repeats), "targets", 1), repeats), "plan", 1)
    # names that docs does not have
    s, whole, threshold, h, n = (common.fresh(f"mix_{x}", docs) for x in ("source", "whole", "threshold", "hash", "n"))
    plan = plan.select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    out = docs.withColumn(h, hashed(F.col("doc_id"), F.col("text"))).join(plan, F.col("source").eqNullSafe(F.col(s)))
    times = F.col(whole) + (F.col(h) < F.col(threshold)).cast("int")
    return out.withColumn(n, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[out[c] for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
ordered AS (
  SELECT *, sum(source_size) OVER () * 150
              - coalesce(sum(source_size * 2) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM weighed),
capped AS (SELECT *, source_size * 2 * 100 * w_rest <= rest * w AS is_full FROM ordered),
leveled AS (SELECT *, max(CASE WHEN NOT is_full THEN CAST(rest AS DOUBLE) / CAST(w_rest * 100 AS DOUBLE) END) OVER () AS level FROM capped),
wanted AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE) ELSE w * level END AS target FROM leveled),
split AS (
  SELECT *, CASE WHEN target >= source_size * 2 THEN 2 WHEN target >= source_size THEN 1 ELSE 0 END AS whole FROM wanted),
runs AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN run <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""
