"""Drift of feature vectors: exact quantiles without sorting, baselines, population stability, samples of the active versions.

All features go through the same jobs as rows (name, feature, value); what comes to the driver is one row per feature and quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import dialect
from . import registry

#: Bins of a baseline, its quantiles, least values, what is added to shares, bounds of the bands, least samples.
BINS, EDGES, LEAST_TRAIN, EPS, WARNING, CRITICAL, LEAST_SAMPLES = 10, (0.01, 0.99), 20, 1e-4, 0.10, 0.20, 50
CELLS = 4096


def quantiles(rows: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """(keys, point, quantile): exact, with linear interpolation, of every group. Nulls and NaN are left out.

    Values are counted in ``CELLS`` equal cells between the least and the greatest; only the cells that hold a wanted rank are
    cut again, between their own least and greatest value, until one value is left. So no task sorts a group, and a value that
    a third of all rows share is one count. The wanted ranks, two per group and point, are kept on the driver."""
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    clean = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    spans = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
    todo = {}  # (group, rank) -> (low, high, rows before low)
    for r in spans:
        for p in points:
            at = (r["n"] - 1) * p
            for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
                todo[(*[r[k] for k in keys], rank)] = (r["low"], r["high"], 0)
    found = {k: low for k, (low, high, _) in todo.items() if low == high}
    kinds = ", ".join(f"`_k{i}` {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    while open_ := {k: x for k, x in todo.items() if k not in found}:
        parts = sorted({(*k[:-1], x[0], x[1]) for k, x in open_.items()}, key=str)
        cells = F.broadcast(spark.createDataFrame(parts, f"{kinds}, low double, high double"))  # at most one per group and rank
        on = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cell = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS), F.lit(CELLS - 1))
        group = [*[f"_k{i}" for i in range(len(keys))], "low", "high"]
        counted = clean.join(cells, on).groupBy(*group, cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("first"), F.max("_v").alias("last"))
        before = F.sum("n").over(Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        wanted = spark.createDataFrame([(*k, *x) for k, x in open_.items()], f"{', '.join(f'`_w{i}` {rows.schema[k].dataType.simpleString()}' for i, k in enumerate(keys))}, rank long, _low double, _high double, skipped long")
        same = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))
        for i in range(len(keys)):
            same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_w{i}"))
        running = counted.withColumn("before", F.coalesce(before, F.lit(0)))
        hits = running.join(F.broadcast(wanted), same).where((F.col("rank") - F.col("skipped") >= F.col("before")) & (F.col("rank") - F.col("skipped") < F.col("before") + F.col("n")))
        for r in hits.collect():
            key = (*[r[f"_w{i}"] for i in range(len(keys))], r["rank"])
            todo[key] = (r["first"], r["last"], r["skipped"] + r["before"])
            if r["first"] == r["last"]:
                found[key] = r["first"]
    out = []
    for r in spans:
        own = [r[k] for k in keys]
        for p in points:
            at = (r["n"] - 1) * p
            low, high = found[(*own, int(at))], found[(*own, min(int(at) + 1, r["n"] - 1))]
            out.append((*own, float(p), low + (high - low) * (at - int(at)), r["low"], r["high"], r["n"]))
    return spark.createDataFrame(out, f"{', '.join(f'`{k}` {rows.schema[k].dataType.simpleString()}' for k in keys)}, point double, quantile double, least double, greatest double, n long")


def baseline(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, low, high, n, bin, share): equal bins between the edges of every feature with enough values; values outside are dropped,
    a constant feature gets one wide bin."""
    q = quantiles(rows, keys, value, EDGES)
    flat = lambda a, b: F.col(b) - F.col(a) < 1e-9
    wide = q.groupBy(*keys).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"), F.first("least").alias("least"), F.first("greatest").alias("greatest"), F.first("n").alias("_all")).where(F.col("_all") >= LEAST_TRAIN)
    wide = wide.withColumn("_flat", flat("low", "high")).withColumn("low", F.when(F.col("_flat"), F.col("least")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("_flat"), F.col("greatest")).otherwise(F.col("high")))
    edges = wide.withColumn("high", F.when(flat("low", "high"), F.col("low") + 1).otherwise(F.col("high"))).select(*keys, "low", "high")
    counts = binned(rows, edges, keys, value)
    every = edges.select(*keys, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    all_ = every.join(counts, [*keys, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    n = F.sum("c").over(Window.partitionBy(*keys))
    return all_.withColumn("n", n).select(*keys, "low", "high", "n", "bin", F.when(F.col("n") > 0, F.col("c") / F.col("n")).otherwise(0.0).alias("share"))


def binned(rows: DataFrame, edges: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, bin, c): how many values are in each bin between low and high, both included."""
    v = F.col(value).cast("double")
    near = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).join(F.broadcast(edges), keys)  # a row per feature
    inside = near.where((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
    return inside.groupBy(*keys, F.least(F.floor((F.col("_v") - F.col("low")) * BINS / (F.col("high") - F.col("low"))), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))


def band(psi) -> F.Column:
    return F.when(psi.isNull() | F.isnan(psi) | (psi < WARNING), "ok").when(psi <= CRITICAL, "warning").otherwise("critical")


def drift(base: DataFrame, samples: DataFrame, keys: list[str], least: int = LEAST_SAMPLES) -> DataFrame:
    """(keys, psi, status, n) of every feature with at least ``least`` samples."""
    v = F.col("value").cast("double")
    n = samples.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= least)
    edges = base.groupBy(*keys).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    both = base.select(*keys, "bin", "share").join(n, keys).join(binned(samples, edges, keys), [*keys, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(Window.partitionBy(*keys))
    s, r = F.when(total > 0, F.col("c") / total).otherwise(0.0) + EPS, F.col("share") + EPS
    psi = F.floor(F.sum("_t") * 1000000 + 0.5) / 1000000
    out = both.withColumn("_t", (s - r) * F.log(s / r)).groupBy(*keys, F.col("n_samples").alias("n")).agg(psi.alias("psi"))
    return out.select(*keys, "psi", band(F.col("psi")).alias("status"), "n")


def newest_samples(predictions: DataFrame, most: int) -> DataFrame:
    """(model, version, id, feature, value) of the newest ``most`` predictions (model, version, id, features) of each model. Spark keeps
    the first ``most`` of each model in every task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("model", "version").orderBy(F.desc("predicted_at"), F.desc("id")))
    few = predictions.withColumn("_n", place).where(F.col("_n") <= most)
    return few.select("model", "version", "id", F.explode("features").alias("feature", "value"))


def merged(rows: DataFrame) -> DataFrame:
    """One row per run of drift rows (model, computed_at, feature, psi, status): worst status, greatest value, features by name."""
    worst = F.max(F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0))
    return rows.groupBy("model", "computed_at").agg(F.element_at(F.array(*map(F.lit, ("ok", "warning", "critical"))), worst + 1).alias("worst"), F.max("psi").alias("max_psi"), F.count("*").alias("n_features"), F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"))


# --- queries ------------------------------------------------------------------------

KEYS = ["model", "feature"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the fixture with a vector of features: the score, the value, a constant, and one that few rows have."""
    p = dialect.run(lambda d: "SELECT * FROM preds", spark, sf_dir)
    maps = F.map_filter(F.create_map(F.lit("score"), F.col("score"), F.lit("value"), F.col("value"), F.lit("constant"), F.lit(3.0), F.lit("rare"), F.when(F.col("id") % 40 == 0, F.col("value"))), lambda k, v: v.isNotNull())
    return p.select("model", "id", "predicted_at", maps.alias("features"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _vectors(spark, sf_dir).where("predicted_at < TIMESTAMP '2024-01-15 00:00:00'")
    return old.select("model", F.explode("features").alias("feature", "value"))


def _samples(spark: SparkSession, sf_dir: str, most: int = 500) -> DataFrame:
    """The newest predictions of the models that the registry has an active version of."""
    active = registry.active(registry._log(spark, sf_dir)).select("model", "version")
    return newest_samples(_vectors(spark, sf_dir).join(F.broadcast(active), "model"), most)


def m14_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = lambda c: (F.floor(F.col(c) * 1000000 + 0.5) / 1000000).alias(c)
    return baseline(_training(spark, sf_dir), KEYS).select(*KEYS, six("low"), six("high"), "n", "bin", "share")


def m15_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(baseline(_training(spark, sf_dir), KEYS), _samples(spark, sf_dir), KEYS, least=1).select("model", "feature", "psi")


def m17_newest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir, 100).select("model", "version", "id", "feature", "value")


def m18_sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift rows: features with too few samples have none."""
    return drift(baseline(_training(spark, sf_dir), KEYS), _samples(spark, sf_dir), KEYS)


def a20_drift_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the monitor, over the newest 500 and the newest 60 samples, merged."""
    base = baseline(_training(spark, sf_dir), KEYS)
    runs = [drift(base, _samples(spark, sf_dir, n), KEYS, least=10).withColumn("computed_at", F.lit(n)) for n in (500, 60)]
    return merged(runs[0].unionByName(runs[1]))


QUERIES = {f.__name__: f for f in (m14_baseline, m15_psi, m17_newest_samples, m18_sample_gate, a20_drift_merge)}

_HEAD = registry._LOG + """, v AS (SELECT p.model, p.id, p.predicted_at, f.feature, CASE f.feature WHEN 'score' THEN p.score WHEN 'constant' THEN 3.0 ELSE p.value END AS value FROM preds p CROSS JOIN (VALUES ('score'), ('value'), ('constant'), ('rare')) f(feature) WHERE f.feature <> 'rare' OR p.id % 40 = 0),
    tr AS (SELECT model, feature, value FROM v WHERE predicted_at < TIMESTAMP '2024-01-15 00:00:00'),
    ed AS (SELECT model, feature, CASE WHEN quantile_cont(value, 0.99) - quantile_cont(value, 0.01) < 1e-9 THEN min(value) ELSE quantile_cont(value, 0.01) END AS low, CASE WHEN quantile_cont(value, 0.99) - quantile_cont(value, 0.01) < 1e-9 THEN greatest(max(value), min(value) + 1) ELSE quantile_cont(value, 0.99) END AS high FROM tr GROUP BY 1, 2 HAVING count(*) >= 20),
    bc AS (SELECT t.model, t.feature, least(CAST(floor((t.value - e.low) * 10 / (e.high - e.low)) AS INT), 9) AS bin FROM tr t JOIN ed e ON e.model = t.model AND e.feature = t.feature WHERE t.value BETWEEN e.low AND e.high),
    base AS (SELECT e.*, (SELECT count(*) FROM bc WHERE bc.model = e.model AND bc.feature = e.feature) AS n, CAST(b.bin AS INT) AS bin, (SELECT CAST(count(*) AS DOUBLE) FROM bc WHERE bc.model = e.model AND bc.feature = e.feature AND bc.bin = b.bin) / (SELECT count(*) FROM bc WHERE bc.model = e.model AND bc.feature = e.feature) AS share FROM ed e CROSS JOIN range(10) b(bin)),
    pl AS (SELECT p.model, p.id, a.version, row_number() OVER (PARTITION BY p.model ORDER BY p.predicted_at DESC, p.id DESC) AS rn FROM preds p JOIN act a ON a.model = p.model)"""


def _drift_sql(name: str, most: int) -> str:
    return f"""{name}s AS (SELECT v.* FROM v JOIN pl ON pl.id = v.id AND pl.rn <= {most}), {name}n AS (SELECT model, feature, count(*) AS n FROM {name}s GROUP BY 1, 2),
    {name}c AS (SELECT b.model, b.feature, b.bin, b.share, count(s.id) AS c FROM base b LEFT JOIN {name}s s ON s.model = b.model AND s.feature = b.feature AND s.value BETWEEN b.low AND b.high AND least(CAST(floor((s.value - b.low) * 10 / (b.high - b.low)) AS INT), 9) = b.bin GROUP BY 1, 2, 3, 4),
    {name}t AS (SELECT *, CAST(c AS DOUBLE) / nullif(sum(c) OVER (PARTITION BY model, feature), 0) AS s FROM {name}c),
    {name} AS (SELECT t.model, t.feature, n.n, floor(sum((coalesce(t.s, 0) + 0.0001E0 - (t.share + 0.0001E0)) * ln((coalesce(t.s, 0) + 0.0001E0) / (t.share + 0.0001E0))) * 1000000 + 0.5) / 1000000 AS psi FROM {name}t t JOIN {name}n n ON n.model = t.model AND n.feature = t.feature GROUP BY 1, 2, 3)"""


_BAND = "CASE WHEN psi < 0.1 THEN 'ok' WHEN psi <= 0.2 THEN 'warning' ELSE 'critical' END"
ORACLE = {
    "m14_baseline": f"WITH {_HEAD} SELECT model, feature, floor(low * 1000000 + 0.5) / 1000000 AS low, floor(high * 1000000 + 0.5) / 1000000 AS high, n, bin, share FROM base",
    "m15_psi": f"WITH {_HEAD}, {_drift_sql('d', 500)} SELECT model, feature, psi FROM d",
    "m17_newest_samples": f"WITH {_HEAD} SELECT v.model, pl.version, v.id, v.feature, v.value FROM v JOIN pl ON pl.id = v.id AND pl.rn <= 100",
    "m18_sample_gate": f"WITH {_HEAD}, {_drift_sql('d', 500)} SELECT model, feature, psi, {_BAND} AS status, n FROM d WHERE n >= 50",
    "a20_drift_merge": f"""WITH {_HEAD}, {_drift_sql('d', 500)}, {_drift_sql('e', 60)}, r AS (SELECT 500 AS computed_at, * FROM d WHERE n >= 10 UNION ALL SELECT 60, * FROM e WHERE n >= 10)
        SELECT model, computed_at, CASE max(CASE WHEN psi < 0.1 THEN 0 WHEN psi <= 0.2 THEN 1 ELSE 2 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS worst, max(psi) AS max_psi, count(*) AS n_features, string_agg(feature, ',' ORDER BY feature) AS features FROM r GROUP BY 1, 2""",
}
