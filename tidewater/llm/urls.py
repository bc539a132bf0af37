"""URL filter: host and path rules first, gradient-boosted trees for the rest.

Rules are configuration (at most ``MAX_RULES``) and become one expression. URLs
that a rule judges are the labelled URLs; a boosted-tree classifier is fitted on
at most ``TRAIN_URLS`` distinct ones of them, those with the smallest hash, and
judges the others by lexical features: length, depth, digit ratio, entropy,
parameter counts, host shape, and smoothed block rates of host and file
suffixes, which are counted over all labelled URLs outside the held-out fold.

Labelled URLs are dealt over ``FOLDS`` folds by a hash. Fold 0 is held out: neither the
trees nor the rates see its labels, so ``by_method`` can be measured on it. The rates of
any other labelled URL are counted without its own fold, so no label stands in its own feature.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule; without labelled URLs of both verdicts the method's verdict is the
one verdict seen, or allow; repeated rows stay repeated; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_join, stage

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MAX_RULES = 256
TRAIN_URLS = 20_000
TREES, DEPTH, SEED = 12, 4, 17
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "has_fragment", "is_https", "tld_block_rate", "tld_share", "file_block_rate", "file_share")


def with_parts(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumn("host", F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_verdict(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Expressions over host and path: the longest rule that fits, and its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an expression holds at most {MAX_RULES}")
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def with_features(judged: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    count = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    tail = F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1)
    return (
        judged.withColumn("length", F.length(url).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("labels", count(F.col("host"), r"\.").cast("double"))
        .withColumn("depth", count(F.col("path"), "/").cast("double"))
        .withColumn("digit_ratio", count(url, "[0-9]") / n)
        .withColumn("entropy", entropy)
        .withColumn("parameters", count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").cast("double"))
        .withColumn("hyphens", count(url, "[-_]").cast("double"))
        .withColumn("has_fragment", (F.instr(url, "#") > 0).cast("double"))
        .withColumn("is_https", url.startswith("https://").cast("double"))
        .withColumn("tld", F.substring_index("host", ".", -1))
        .withColumn("file", F.lower(tail))
    )


def with_suffix_rates(rows: DataFrame, column: str, total: int) -> DataFrame:
    """Adds the share of a row's suffix among all rows, and the suffix's block rate among labelled rows, smoothed by
    one of each, of all folds but the held-out one and the row's own."""
    of = lambda fold, more: F.count_if((F.col("fold") == fold) & more)
    labelled = F.array(*[of(i, F.col("by_rule").isNotNull()) for i in range(1, FOLDS)])
    blocked = F.array(*[of(i, F.col("by_rule") == "block") for i in range(1, FOLDS)])
    counted = stage(rows.groupBy(F.col(column).alias("_s")).agg(F.count("*").alias("_n"), labelled.alias("_m"), blocked.alias("_b")), "url-suffixes")
    met = small_join(rows, counted, F.col(column) == F.col("_s"))
    own = lambda c: F.when(F.col("by_rule").isNotNull() & (F.col("fold") > 0), F.element_at(c, F.col("fold"))).otherwise(0)
    left = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x) - own(F.col(c))
    met = met.withColumn(f"{column}_block_rate", (left("_b") + 1) / (left("_m") + 2)).withColumn(f"{column}_share", F.col("_n") / max(total, 1))
    return met.drop("_s", "_n", "_m", "_b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, by_method (for every row), held_out (a rule judges it, but training has not seen it)."""
    rule, verdict = rule_verdict(rules)
    rows = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url")))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    rows = stage(with_features(rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("fold", fold)), "urls")
    total = rows.count()
    for column in ("tld", "file"):
        rows = with_suffix_rates(rows, column, total)
    label = (F.col("by_rule") == "block").cast("double")
    train = rows.where(F.col("by_rule").isNotNull() & (F.col("fold") > 0)).groupBy("url").agg(F.first(label).alias("label"), *[F.first(c).alias(c) for c in FEATURES])
    train = stage(train.orderBy(F.xxhash64("url"), "url").limit(train_urls), "url-training")
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) == 2:
        put = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(put.transform(train))
        scored = model.transform(put.transform(rows)).withColumn("by_method", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    else:
        scored = rows.withColumn("by_method", F.lit("block" if seen.get(1.0) else "allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_method").alias("verdict"), "by_method", (F.col("by_rule").isNotNull() & (F.col("fold") == 0)).alias("held_out"))
