"""Trailing windows per key that do not put a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing(rows: DataFrame, key: str, at: str, order: str, window: int, sums: Sequence[str] = (), cell: int | None = None, own: bool = False) -> DataFrame:
    """``rows`` with ``n``, the rows of the same ``key`` within ``window`` before each, and ``sum_<c>`` of every column in ``sums``.

    ``at`` is a long (say, microseconds). Above, the window is positional: rows before
    this one by (``at``, ``order``), with ``own`` this one too; below it is by value:
    ``at`` of this row less ``window`` belongs to it. ``order`` is unique. No rows
    before give n = 0 and sums of 0; null values count in n and add 0 to sums.

    Time is cut into cells of ``cell`` (default: a tenth of the window). Counts and sums of
    whole cells are aggregated first and added up per key, a row per cell; inside a cell
    rows are numbered by a window over (key, cell). So a key that holds a third of all
    rows is still spread over its cells. The lower edge is a row of its own in its cell.
    """
    cell = cell or max(1, window // 10)
    one = F.struct(*[F.col(c).alias(c) for c in rows.columns]).alias("_row")
    values = [F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)).alias(f"_v{i}") for i, c in enumerate(sums)]
    base = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(order).alias("_o"), *values, one)
    zero = [F.lit(0).cast(rows.schema[c].dataType).alias(f"_v{i}") for i, c in enumerate(sums)]
    kept = [f"_v{i}" for i in range(len(sums))]
    upper = base.select("_k", "_t", "_o", F.lit(1).alias("_is"), *kept, "_row")
    edges = base.select("_k", (F.col("_t") - window).alias("_t"), "_o", F.lit(0).alias("_is"), *zero, F.lit(None).cast(base.schema["_row"].dataType).alias("_row"))
    both = upper.union(edges).withColumn("_c", F.floor(F.col("_t") / cell))
    counted = ["_is", *kept]
    cells = both.groupBy("_k", "_c").agg(*[F.sum(c).alias(f"_in{c}") for c in counted])
    earlier = W.partitionBy("_k").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("_k").alias("_ck"), F.col("_c").alias("_cc"), *[F.sum(f"_in{c}").over(earlier).alias(f"_before{c}") for c in counted])
    inside = W.partitionBy("_k", "_c").orderBy("_t", "_is", "_o").rowsBetween(W.unboundedPreceding, -1)
    met = both.join(cells, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_c") == F.col("_cc")))
    nothing = lambda c: F.lit(0)
    upto = [(F.coalesce(F.sum(c).over(inside), nothing(c)) + F.coalesce(F.col(f"_before{c}"), nothing(c)) + (F.col(c) if own else nothing(c))).alias(f"_up{c}") for c in counted]
    met = met.select("_o", "_is", "_row", *upto)
    diff = [(F.max(F.when(F.col("_is") == 1, F.col(f"_up{c}"))) - F.max(F.when(F.col("_is") == 0, F.col(f"_up{c}")))).alias(f"_d{c}") for c in counted]
    out = met.groupBy("_o").agg(F.max_by("_row", "_is").alias("_row"), *diff)
    return out.select("_row.*", F.col("_d_is").alias("n"), *[F.col(f"_d_v{i}").alias(f"sum_{c}") for i, c in enumerate(sums)])


def trailing_days(rows: DataFrame, key: str, day: str, order: str, days: int, sums: Sequence[str] = ()) -> DataFrame:
    """As ``trailing`` for times in whole days: rows of the ``days`` days before a row's own, and of its own day those before it by ``order``.

    The lower edge is the beginning of a day, so whole days are counted and added up per key, a row per day, and
    rows meet them once: they are shuffled once by (key, day), and none is there twice. A null key or day has no rows before it.
    """
    zero = {c: F.lit(0).cast(rows.schema[c].dataType) for c in sums}
    totals = rows.groupBy(F.col(key).alias("_k"), F.col(day).alias("_d")).agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(F.col(c), zero[c])).alias(f"_s{i}") for i, c in enumerate(sums)])
    earlier = W.partitionBy("_k").orderBy("_d").rangeBetween(-days, -1)
    totals = totals.where("_d IS NOT NULL").select("_k", "_d", F.sum("_n").over(earlier).alias("_n"), *[F.sum(f"_s{i}").over(earlier).alias(f"_s{i}") for i in range(len(sums))])
    inside = W.partitionBy(key, day).orderBy(order)
    upto = inside.rowsBetween(W.unboundedPreceding, -1)
    own = rows.select("*", (F.row_number().over(inside) - 1).alias("_own"), *[F.sum(F.coalesce(F.col(c), zero[c])).over(upto).alias(f"_own{i}") for i, c in enumerate(sums)])
    met = own.join(totals, (F.col(key) == F.col("_k")) & (F.col(day) == F.col("_d")), "left")
    known = F.col("_k").isNotNull()
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    added = [F.when(known, none(f"_own{i}") + none(f"_s{i}")).otherwise(F.lit(0)).alias(f"sum_{c}") for i, c in enumerate(sums)]
    return met.select(*rows.columns, F.when(known, F.col("_own") + none("_n")).otherwise(F.lit(0)).cast("long").alias("n"), *added)
