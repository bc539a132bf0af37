"""Helpers shared by the corpus operators.

``stage`` cuts lineage with a table written under ``spark.checkpoint.dir``;
``small_join`` broadcasts a lookup side only after its row count was checked;
``word_hashes`` turns a batch of texts into 64-bit word hashes with numpy.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side may be broadcast.
BROADCAST_ROWS = 500_000
#: Copies of each lookup row, and random salts of the large side, beyond that.
SALTS = 32
#: White space of every word definition here: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode is one made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table, so that a
    lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def folder(spark: SparkSession, label: str) -> str:
    """A new folder for files in the shared folder; inside ``scratch`` it goes with the tables."""
    path = f"{shared_dir(spark)}/tidewater/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``stage`` writes inside are deleted at the end, but for those given to
    the function it yields. What is returned must read from those only."""
    made, kept = [], set()
    _OPEN.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.staged_at)
        return table

    try:
        yield keep
    finally:
        _OPEN.remove(made)
        if _OPEN:
            _OPEN[-1].extend(kept)
        for path in made:
            if path not in kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_join(big: DataFrame, lookup: DataFrame, on: Column, how: str = "inner", rows: int | None = None, most: int | None = None) -> DataFrame:
    """Join ``big`` with a lookup table that has one row per key.

    The lookup side is counted first (or ``rows`` tells its proven size). Up to ``most``
    (``BROADCAST_ROWS``) rows it is broadcast; beyond that each lookup row is copied to
    ``SALTS`` salts and the large side dealt over them by a hash of the row and its
    partition, so that a key that holds a third of the rows is still spread over many
    tasks, and a task that runs again deals its rows the same way. This join is a merge:
    Spark would judge the copies by the packed size of the lookup's file, and
    broadcast many millions of rows that take a few megabytes there.
    """
    n = lookup.count() if rows is None else rows
    if n <= (BROADCAST_ROWS if most is None else most):
        return big.join(F.broadcast(lookup), on, how)
    salted = lookup.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in big.schema])
    dealt = big.withColumn("_salt_l", F.pmod(hashed + F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), on & (F.col("_salt_l") == F.col("_salt_r")), how).drop("_salt_l", "_salt_r")


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """(row, doc): the documents written once, all their columns in ``doc``, with a key of
    the written row, so that null and repeated ids and clashing names do no harm."""
    return stage(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), label)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents of ``keyed`` rows, all columns, whose row is not among ``gone`` (row)."""
    gone = gone.select(F.col("row").alias("_r"))
    lookup = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return rows.select("row", "doc").join(lookup, F.col("row") == F.col("_r"), "left_anti").select("doc.*")


def text_key() -> Column:
    """Digest of a document's text; null texts count as empty."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def without_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents, all columns, whose text has no key among the distinct ``key`` of ``gone``:
    for decisions that depend on the text alone, whatever the id."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text_key().alias("_t"))
    return small_join(rows, gone.select("key"), F.col("_t") == F.col("key"), "left_anti").select("doc.*")


def doc_crc_fold(col: Column, folds: int = 5) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % folds


# --- vectorised words -------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_POWERS: dict[np.uint64, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def word_hashes(blobs: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and, per text, the end of its words.

    A word's hash is the sum of (random value of byte) * base^(place in the word)
    modulo 2^64, read off prefix sums over the joined batch, then finalised.
    ``fold`` takes A-Z as a-z.
    """
    joined = b" ".join([*blobs, b""])
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(b) + 1 for b in blobs]) if blobs else np.zeros(0, dtype=np.int64)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(blobs), dtype=np.int64)
    gap = _SPACE[raw]
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    last = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    with np.errstate(over="ignore"):
        values = (_FOLDED if fold else _BYTE)[raw] * _powers(len(raw), _ODD)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
        hashes = mix((sums[last] - sums[first]) * _powers(len(raw), _INVERSE)[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, ends, side="left")


CHUNK = 1 << 20  # bytes hashed at once


def _cut(blob: bytes) -> list[bytes]:
    """Parts of about CHUNK bytes, cut at white space."""
    parts, at = [], 0
    while len(blob) - at > CHUNK:
        end = next((i for i in range(at + CHUNK, len(blob)) if _SPACE[blob[i]]), len(blob))
        parts.append(blob[at:end])
        at = end
    return [*parts, blob[at:]]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words."""
    n = len(words) - k + 1
    if k < 1 or n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            out = mix(out * _ODD + words[j : j + n])
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its windows of ``k`` words (A-Z folded);
    with fewer words the whole sequence as one, without words none."""
    out: list[np.ndarray] = []
    for group in _groups([(t or "").encode("utf-8") for t in texts]):
        if len(group) == 1 and len(group[0]) > CHUNK:
            words = np.concatenate([word_hashes([part])[0] for part in _cut(group[0])])
            ends = np.array([len(words)])
        else:
            words, ends = word_hashes(group)
        windows, begin = shingle_hashes(words, k), 0
        for end in ends.tolist():
            n = end - begin
            out.append(np.unique(windows[begin : end - k + 1] if n >= k else shingle_hashes(words[begin:end], n)))
            begin = end
    return out


def _groups(blobs: list[bytes]):
    group: list[bytes] = []
    held = 0
    for b in blobs:
        if group and held + len(b) > CHUNK:
            yield group
            group, held = [], 0
        group.append(b)
        held += len(b)
    if group:
        yield group
