"""Toxicity by weak supervision.

1. A lexicon of words and word beginnings is mined on at most ``TRAIN_DOCS``
   labelled documents (smallest hash first; the bound is this parameter), never
   from the held-out fold.
2. Voters look at every document: the lexicon dealt over ``LEXICON_VOTERS``
   voters, and pattern voters. A voter votes toxic or abstains.
3. A generative label model is fitted to the counts of vote patterns over all
   documents (at most 2^voters of them): expectation maximisation gives each
   voter's rates of voting in either class, and pairs that agree more than the
   classes explain share their weight.
4. A linear classifier over lexicon and pattern features is trained on the
   posterior labels of the bounded sample and scores every document.

Labels, language, source and id are never inputs of a score. Defined results:
null text is empty; a text without words has no features and scores by the
classifier's intercept, capped below 0.5; a null id counts as held out; without
training labels of both classes every score is 0; repeated rows stay repeated; an
empty table gives no rows; extra columns are not read. Of several texts with one
labelled id, training takes the one whose hash is smallest.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc_fold, scratch, stage, text_key, without_texts

TRAIN_DOCS, TERMS, LEXICON_VOTERS, FOLDS = 20_000, 384, 8, 5
LEAST_DOCS, LEAST_ODDS = 5, 2.5
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("symbols", "shouting", "exclaims", "stretched", "masked")
_MASKED = re.compile(r"[A-Za-z]\*{2,}[A-Za-z]?|[A-Za-z][@$!#]{2,}[A-Za-z]")
_STRETCHED = re.compile(r"([A-Za-z])\1{3,}")


def terms_of(text: str) -> set[str]:
    """Lower-case words, and their first four to six letters marked as beginnings."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        for n in (4, 5, 6):
            if len(w) >= n:
                out.add(w[:n] + "*")
    return out


def pattern_values(text: str) -> list[float]:
    n = max(1, len(text))
    plain = sum(map(str.isalnum, text)) + text.count(" ") + text.count("\n")
    upper = len(re.findall(r"\b[A-Z]{3,}\b", text))
    return [1 - plain / n, upper / (1 + text.count(" ")), min(5, text.count("!!")), min(5, len(_STRETCHED.findall(text))), min(5, len(_MASKED.findall(text)))]


PATTERN_VOTES = (0.25, 0.2, 1, 1, 1)  # at or above which a pattern voter votes


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents outside the held-out fold; a document labelled twice counts as toxic if one label says so."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc_fold(F.col("doc_id"), FOLDS) != 0))
    own = own.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = own.select(F.col("doc_id").alias("_l"), "toxic")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("_l"))  # at most ``most`` rows
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    return joined.groupBy("doc_id", "toxic").agg(first).select("doc_id", "toxic", F.col("first.text").alias("text"))


def mine_lexicon(train: DataFrame, size: int = TERMS) -> list[str]:
    def count(batches):
        pos, neg = Counter(), Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (pos if y else neg).update(terms_of(t or ""))
        keys = [k for k in pos if pos[k] > 1] or list(pos)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["term", "pos", "neg"])
        rest = list(neg.keys() - set(keys))
        for i in range(0, len(rest), 50_000):
            part = rest[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([neg[k] for k in part], pa.int64())], names=["term", "pos", "neg"])

    sizes = train.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    if not n.get(1) or not n.get(0):
        return []
    counts = train.select("toxic", "text").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / n[1]) - F.log((F.col("neg") + 0.5) / n[0])
    good = counts.where((F.col("pos") >= min(LEAST_DOCS, max(1, n[1] // 4))) & (odds >= LEAST_ODDS))
    return [r["term"] for r in good.orderBy((odds * F.log(F.col("pos") + 1.0)).desc(), "term").limit(size).collect()]


def look(docs: DataFrame, lexicon: list[str], key: str = "doc_id") -> DataFrame:
    """``key``, votes (bits), terms (indexes of lexicon terms found) and pattern values, of every whole text."""
    at = {t: i for i, t in enumerate(lexicon)}

    def run(batches):
        for b in batches:
            votes, terms, values = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                found = sorted({at[t] for t in terms_of(text) & at.keys()})
                p = pattern_values(text)
                bits = 0
                for i in found:
                    bits |= 1 << i % LEXICON_VOTERS
                for i, (v, least) in enumerate(zip(p, PATTERN_VOTES)):
                    bits |= (v >= least) << LEXICON_VOTERS + i
                votes.append(bits)
                terms.append(found)
                values.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=[key, "votes", "terms", "patterns"])

    rows = docs.select(F.col(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, votes int, terms array<int>, patterns array<double>")


class LabelModel:
    """Two latent classes over voters that vote toxic or abstain, fitted to pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 200):
        v = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
        n = counts.astype(float)
        lexicon = v[:, :LEXICON_VOTERS].sum(axis=1)
        q = np.where(lexicon >= 2, 0.95, np.where(lexicon == 1, 0.5, 0.02))
        for _ in range(rounds):
            self.prior = np.clip((n * q).sum() / n.sum(), 1e-3, 0.5)
            self.hit = np.clip(((n * q) @ v + 0.1) / ((n * q).sum() + 0.2), 1e-3, 1 - 1e-3)  # accuracy: votes on toxic documents
            self.false = np.clip(((n * (1 - q)) @ v + 0.1) / ((n * (1 - q)).sum() + 0.2), 1e-5, 1 - 1e-3)
            self.share = np.ones(voters)
            new = self._posterior(v)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        # What two voters agree on beyond what the classes explain.
        residual = v - (q[:, None] * self.hit + (1 - q)[:, None] * self.false)
        cov = (residual * n[:, None]).T @ residual / n.sum()
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        self.correlation = cov / sd[:, None] / sd
        self.share = 1 / (1 + np.clip(self.correlation - np.eye(voters), 0, None).sum(axis=1))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        on, off = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        z = np.log(self.prior / (1 - self.prior)) + (v * on + (1 - v) * off) @ self.share
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior((patterns[:, None] >> np.arange(len(self.hit)) & 1).astype(float))


def features(terms: list, patterns: list, size: int) -> np.ndarray:
    """Which terms stand in the text, how many (log), and the pattern values."""
    x = np.zeros((len(terms), size + 1 + len(PATTERNS)))
    for i, found in enumerate(terms):
        x[i, found] = 1
        x[i, size] = np.log1p(len(found))
    if len(terms):
        x[:, size + 1 :] = np.asarray(patterns, dtype=float)
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a ridge."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score_rows(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``key`` and score of every row of ``docs`` (doc_id, text and a column of that name)."""
    with scratch(docs.sparkSession) as keep:
        return _score_rows(docs, labels, key, keep)


def _score_rows(docs: DataFrame, labels: DataFrame, key: str, keep) -> DataFrame:
    train = stage(training_rows(docs, labels), "toxic-training")
    lexicon = mine_lexicon(train)
    if lexicon:
        seen = keep(stage(look(docs, lexicon, key), "toxic-votes"))
        rows = seen.groupBy("votes").count().collect()  # at most 2^13 patterns
        model = LabelModel(np.array([r["votes"] for r in rows]), np.array([r["count"] for r in rows]), LEXICON_VOTERS + len(PATTERNS))
        sample = look(train.select("doc_id", "text"), lexicon).collect()  # at most TRAIN_DOCS rows
        posterior = model.posterior(np.array([r["votes"] for r in sample]))
        w, b = fit_linear(features([r["terms"] for r in sample], [r["patterns"] for r in sample], len(lexicon)), posterior)
        b = min(b, -1e-3)
    else:
        seen, w, b = docs.select(key, F.array().cast("array<int>").alias("terms"), F.array().cast("array<double>").alias("patterns")), None, 0.0

    def run(batches):
        for batch in batches:
            if w is None:
                s = np.zeros(batch.num_rows)
            else:
                x = features(batch.column(1).to_pylist(), batch.column(2).to_pylist(), len(lexicon))
                s = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=[key, "score"])

    return seen.select(key, "terms", "patterns").mapInArrow(run, f"{key} {seen.schema[key].dataType.simpleString()}, score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "doc_id")
    held = F.coalesce(doc_crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, all columns. Each row is judged by its own text, whatever its id."""
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    with scratch(docs.sparkSession) as keep:
        bad = keep(stage(score_rows(rows, labels, "key").where("score >= 0.5").select("key").distinct(), "toxic"))
    return without_texts(docs, bad)
