"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 40-bit hash of its id; rows of one source whose ids are equal or
null have one of id, text and ordinal among equal rows, so that no id is an atom. Sizes are summed by source and hash
bucket; the bucket where a source's budget is reached is refined with the next
bits of the hash, and only that bucket, until it is a single hash value. A
document is then taken by comparing its hash with its source's threshold:
nothing is sorted and no document list leaves the executors.

A source whose target exceeds its size takes every document ``whole`` times and
finds the threshold for the rest. Documents are taken whole; the last one goes
in if that brings the source nearer to its target (a tie takes it).

Defined results: null text has size 0 and takes 0 words; a null source is a
source of its own, after all others; which of several rows with equal ids and texts is taken is open, how many are is not;
very long texts are only counted and digested; extra columns are carried aside and cannot
clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, keyed, scratch, small_join, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
LEVELS = (12, 14, 14)  # bits of the hash that each histogram looks at
RUN = 17  # bits of a written row's number inside a run of rows that is numbered by one task


def hash40(name: Column, seed: str = SEED) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 10), 16, 10).cast("long")


def named(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, digest): all that the mix needs, without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(text.cast("binary")).alias("digest"))


def repeats(rows: DataFrame) -> DataFrame | None:
    """(row, h) of the rows with words of the written ``rows`` whose id is not theirs alone in their source; None
    without such. Equal rows are numbered by runs of written rows, so that no group of them is one task."""
    some = rows.where("size > 0")
    again = some.groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d")).count().where("count > 1").drop("count")
    again = stage(again, "mix-again")
    n = again.count()
    if not n:
        return None
    own = small_join(some, again, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), rows=n)
    group = ["source", "doc_id", "digest"]
    own = stage(own.select("row", *group, F.shiftright("row", RUN).alias("run")), "mix-repeats")
    before = W.partitionBy(*group).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = own.groupBy(*group, "run").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in (*group, "run")], "before")
    same = F.col("run") == F.col("_run")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.col("before") + F.row_number().over(W.partitionBy(*group, "run").orderBy("row")) - 1
    found = own.join(runs, same).select("row", F.concat_ws(":", named(F.col("doc_id")), "digest", place).alias("name"))
    return stage(found.select(F.col("row").alias("_r"), hash40(F.col("name")).alias("_h")), "mix-places")


def hashed(rows: DataFrame, own: DataFrame | None) -> DataFrame:
    """``rows`` (row, doc_id, ...) with their hash ``h``, that of ``repeats`` where there is one."""
    alone = hash40(named(F.col("doc_id")))
    if own is None:
        return rows.withColumn("h", alone)
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    return rows.join(own, F.col("row") == F.col("_r"), "left").withColumn("h", F.coalesce("_h", alone)).drop("_r", "_h")


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to targets: weights repeat over the sources in code-point
    order, null last; none is above ``most`` times its size, and the excess goes to
    the others by weight. One row per source, so its windows are small.

    With sources in the order of size by weight, those that stop are a prefix; the
    first level that the next source does not exceed is the water level.
    """
    ws = F.array(*[F.lit(float(w)) for w in weights])
    one = W.partitionBy(F.lit(0))
    base = sizes.withColumn("w", F.element_at(ws, ((F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    base = base.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = one.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    base = base.withColumn("level", (F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    base = base.withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    base = base.withColumn("water", F.min_by("level", F.when(F.col("fits"), F.col("cap") / F.col("w"))).over(one))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w")))
    return base.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: ``whole`` copies of every document, and the hash below
    which one more is taken."""
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", ratio).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    left, n = sum(LEVELS), None
    for bits in LEVELS:
        left -= bits
        state = stage(state, "mix-levels")
        n = n if n is not None else state.count()
        open_ = state.where(F.col("need") > 0).select(F.col("source").alias("s"), "need", "prefix", "before")
        inside = small_join(rows, open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", left + bits) == F.col("prefix")), rows=n)
        bucket = inside.groupBy("s", "need", "before", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        over = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        summed = bucket.withColumn("upto", F.col("before") + F.sum("in_bucket").over(over))
        edge = summed.where(F.col("upto") >= F.col("need")).groupBy("s").agg(F.min_by(F.struct("bucket", "upto", "in_bucket"), "bucket").alias("e"))
        keep = [c for c in state.columns if c not in ("prefix", "before", "last")]
        state = state.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")), "left") if n <= 500_000 else state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        state = state.select(*keep, F.coalesce(F.col("e.bucket"), F.lit(0)).alias("prefix"), F.coalesce(F.col("e.upto") - F.col("e.in_bucket"), F.lit(0)).alias("before"), F.coalesce(F.col("e.in_bucket"), F.lit(0)).alias("last"))
    nearer = (F.col("need") - F.col("before")) * 2 >= F.col("last")
    below = F.when(F.col("need") <= 0, 0).when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).cast("long")
    return state.select("source", "source_size", "target", "whole", below.alias("below"))


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, below) of every source of ``hashed`` rows."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stage(thresholds(rows, water_fill(sizes, weights, share, most)), "mix-plan")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, words taken."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(stage(sized(docs), "mix-sizes"))
        own = repeats(rows)
        rows = hashed(rows, own if own is None else keep(own))
        found = keep(plan(rows, weights, share, most)).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("whole") + (F.col("h") < F.col("below")).cast("long"))
    return small_join(rows, found, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns; one that the mix takes twice is there twice.
    Documents without words, which a mix of words neither takes nor leaves, stay once.
    Only where ids repeat are the documents written first, so that each has a number."""
    with scratch(docs.sparkSession) as keep:
        whole = docs.select(F.struct(*docs.columns).alias("doc"), F.lit(0).cast("long").alias("row"))
        rows = stage(sized(docs), "mix-sizes")
        own = repeats(rows)
        if own is not None:
            whole = keep(keyed(docs, "mix-documents"))
            rows = stage(sized(whole.select("doc.doc_id", "doc.source", "doc.text", "row"), F.col("row")), "mix-sizes")
            own = keep(repeats(rows))
        found = keep(plan(hashed(rows, own))).select(F.col("source").alias("s"), "whole", "below")
    has_words = F.coalesce(F.col("doc.text").cast("string").rlike(WORD), F.lit(False))
    rows = hashed(whole.select("row", "doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), has_words.alias("words")), own)
    times = F.when(~F.col("words"), 1).otherwise(F.col("whole") + (F.col("h") < F.col("below")).cast("long"))
    met = small_join(rows, found, F.col("source").eqNullSafe(F.col("s"))).select("doc", times.cast("int").alias("n")).where("n > 0")
    return met.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


#: Rows of ``mix`` in DuckDB SQL over a table ``{docs}``.
SQL = r"""
WITH counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM {docs}),
placed AS (
  SELECT *, size > 0 AND count(*) FILTER (size > 0) OVER (PARTITION BY source, doc_id) > 1 AS again,
         row_number() OVER (PARTITION BY source, doc_id, digest ORDER BY doc_id) - 1 AS place FROM counted),
sized AS (
  SELECT doc_id, source, size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || CASE WHEN again THEN ':' || digest || ':' || place ELSE '' END), 1, 10))::BIGINT AS h FROM placed),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1) AS w, source_size * 2.0::DOUBLE AS cap FROM src),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lvl AS (SELECT min_by(level, cap / w) FILTER (level <= cap / w) AS water FROM lv),
tg AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM lv, lvl),
tk AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM tg),
hs AS (SELECT source, h, sum(size)::BIGINT AS in_h FROM sized GROUP BY source, h),
cum AS (SELECT *, sum(in_h) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hs),
edge AS (SELECT c.source, min_by(h, h) AS eh, min_by(upto - in_h, h) AS eb, min_by(in_h, h) AS el
         FROM cum c JOIN tk t ON c.source IS NOT DISTINCT FROM t.source
         WHERE t.target - t.whole * t.source_size > 0 AND upto >= t.target - t.whole * t.source_size GROUP BY c.source),
plan AS (SELECT t.*, CASE WHEN t.target - whole * source_size <= 0 THEN 0 WHEN (t.target - whole * source_size - coalesce(eb, 0)) * 2 >= coalesce(el, 0) THEN coalesce(eh, 0) + 1 ELSE coalesce(eh, 0) END AS below
         FROM tk t LEFT JOIN edge e ON t.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.size, p.source_size, p.target, (s.size * (p.whole + (s.h < p.below)::BIGINT))::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
"""
