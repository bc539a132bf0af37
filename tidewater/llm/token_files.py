"""Token-id files: raw little-endian ids with a minimal perfect hash index.

Documents are dealt over shards by ranges of ascending doc_id. A shard is three raw
files in the shared folder: ``.ids`` holds unsigned ids of 16 bits (32 bits where the
vocabulary needs them), nothing else;
``.ends`` the end of each document in it as unsigned 64-bit numbers; ``.index`` a
minimal perfect hash from document key to slot, with a 32-bit fingerprint and the
rows of the key in each slot, but no key. The table of shards (path, width of an id, sizes,
range of keys) is what ``write_files`` returns. A key is found by its shard's range and then in
constant time: slot, fingerprint, two ends, and one read of exactly its bytes.

A task writes files under a name of its own attempt, and only the shards in the
committed table exist for readers, so a lost executor or a second attempt leaves no
half-written shard in it (its files stay unused). Files go through ``pyarrow.fs``,
which must know the scheme of the shared folder.

Defined results: null text is empty and yields the end id alone; a null doc_id
comes first and has the key of the smallest long; rows with equal ids share a
slot and stay in order of a text hash, then the text; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shared_dir, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
NULL_KEY = -(1 << 63)
CACHE, LONGEST = 250_000, 64  # pieces of a generation of the cache, and code points of a piece that is kept
FLUSH = 1 << 22  # bytes held before they are written, and read at once
#: Places where byte-level pre-tokenisation always cuts: it never joins what stands on both sides.
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\x1c-\x1f]|<\|")
#: The pre-tokens of a piece that has only these letters, ASCII digits and ASCII signs.
_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u4e00-\u9fff]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level form: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 256 + others.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of pieces.

    Byte-level pre-tokenisation cuts before the last blank of a run and at other
    white space, so the ids of a text are those of its pieces in order. A piece of
    common letters, digits and signs is cut into its pre-tokens here and these go to
    the library's model; any other piece goes to the library as it is. Texts with
    control separators or special tokens are encoded in one call.
    """

    def __init__(self, path: str | None = None, width: int | None = 4):
        """``width``: bytes of an id, None for as many as the vocabulary needs."""
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.width = width or (2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4)
        self.code = {2: "H", 4: "I"}[self.width]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known = _Known(self.piece, {})

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        words = _WORDS.findall(piece)
        if sum(map(len, words)) != len(piece):
            return self.whole(piece)
        if len(words) > 1:
            return b"".join(map(self.known.__getitem__, words))
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return self.whole(text)
        if len(self.known) > CACHE:  # what is not used again until the next turn is forgotten
            self.known = _Known(self.piece, dict(self.known))
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))


class _Known(dict):
    def __init__(self, encode, old: dict):
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def encoder_of_process(path: str | None = None) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, None)
    return _ENCODERS[path]


# --- minimal perfect hash ---------------------------------------------------

LEVELS = 24


def _at(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03))


def build_index(keys: np.ndarray) -> bytes:
    """Index over ascending ``keys`` (repeats are neighbours): levels of bit arrays
    where a key that is alone at its place stays and the others go on, then per
    slot the fingerprint, first row and number of rows."""
    unique, first, count = np.unique(keys, return_index=True, return_counts=True)
    left, bits, slots, base = np.arange(len(unique)), [], np.zeros(len(unique), dtype=np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        m = max(64, -(-2 * len(left) // 64) * 64)
        place = _at(unique[left], level) % np.uint64(m)
        alone = np.bincount(place.astype(np.int64), minlength=m) == 1
        stays = alone[place.astype(np.int64)]
        rank = np.cumsum(alone) - alone
        slots[left[stays]] = base + rank[place[stays].astype(np.int64)]
        base += int(alone.sum())
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~stays]
    slots[left] = base + np.arange(len(left))  # practically none: kept as a list of keys
    table = np.zeros(len(unique), dtype=[("print", "<u4"), ("row", "<u4"), ("rows", "<u4")])
    table["print"][slots] = (_at(unique, 63) >> np.uint64(32)).astype(np.uint32)
    table["row"][slots], table["rows"][slots] = first, count
    head = np.array([len(unique), len(left), len(bits), *(len(b) for b in bits)], dtype="<u4").tobytes()
    return head + b"".join(b.tobytes() for b in bits) + unique[left].astype("<i8").tobytes() + table.tobytes()


class Index:
    def __init__(self, data: bytes):
        n, rest, levels = np.frombuffer(data, "<u4", 3)
        sizes = np.frombuffer(data, "<u4", int(levels), 12)
        at, base, self.levels = 12 + 4 * int(levels), 0, []
        for size in sizes.tolist():
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little").astype(bool)
            self.levels.append((bits, base + np.cumsum(bits) - bits))
            at, base = at + size, base + int(bits.sum())
        self.rest = {int(k): base + i for i, k in enumerate(np.frombuffer(data, "<i8", int(rest), at))}
        self.table = np.frombuffer(data, [("print", "<u4"), ("row", "<u4"), ("rows", "<u4")], int(n), at + 8 * int(rest))

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows where the fingerprint differs."""
        keys = np.asarray(keys, dtype=np.int64)
        slot, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            place = (_at(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            slot[left[bits[place]]] = rank[place[bits[place]]]
            left = left[~bits[place]]
        for i in left:
            slot[i] = self.rest.get(int(keys[i]), -1)
        if not len(self.table):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        found = self.table[np.maximum(slot, 0)]
        hit = (slot >= 0) & (found["print"] == (_at(keys, 63) >> np.uint64(32)).astype(np.uint32))
        return found["row"].astype(np.int64), np.where(hit, found["rows"], 0).astype(np.int64)


# --- files ------------------------------------------------------------------


def write_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and write the shards; returns the table of shards:
    part, path (without ending), width (bytes of an id), n_docs, n_ids, first_key, last_key."""
    folder = f"{shared_dir(docs.sparkSession)}/tidewater/tokens-{uuid.uuid4().hex}"
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of_process(tokenizer), TaskContext.get()
        end = end_id.to_bytes(encoder.width, "little")
        store, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}"
        keys, ends, held, size, at, ids = array("q"), array("Q"), [], 0, 0, None
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if ids is None:
                    store.create_dir(root, recursive=True)
                    ids = store.open_output_stream(path + ".ids")
                encoded = encoder.encode(text.as_py() or "")
                held += (encoded, end)
                size += len(encoded) + len(end)
                at += len(encoded) // len(end) + 1
                keys.append(NULL_KEY if key is None else key)
                ends.append(at)
                if size >= FLUSH:
                    ids.write(b"".join(held))
                    held, size = [], 0
        if ids is None:
            return
        ids.write(b"".join(held))
        ids.close()
        for ending, data in ((".ends", np.frombuffer(ends, np.uint64).astype("<u8").tobytes()), (".index", build_index(np.frombuffer(keys, np.int64)))):
            with store.open_output_stream(path + ending) as out:
                out.write(data)
        row = (task.partitionId(), path.removeprefix(root), encoder.width, len(keys), at, keys[0], keys[-1])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    shards = dealt.select("doc_id", "text").mapInArrow(run, "part int, path string, width int, n_docs long, n_ids long, first_key long, last_key long")
    return stage(shards.withColumn("path", F.concat(F.lit(folder), "path")), "token-shards")


class Shards:
    """The table of shards in memory: one row per write task, none per document."""

    def __init__(self, files: DataFrame):
        rows = sorted(files.collect(), key=lambda r: r["part"])
        self.paths = [(r["path"], r["width"]) for r in rows]
        self.first, self.last = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("first_key", "last_key"))
        self.base = np.cumsum([0, *(r["n_ids"] for r in rows)])[:-1]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) for every shard that may hold a key; equal ids can stand in several."""
        low, high = np.searchsorted(self.last, keys, "left"), np.searchsorted(self.first, keys, "right")
        n = np.maximum(high - low, 0)
        shard = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return shard.astype(np.int32), np.repeat(keys, n)


class Shard:
    """One shard opened for keyed reads."""

    def __init__(self, path: str, width: int):
        self.width = width
        store, name = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(name + ".index") as f:
            self.index = Index(f.read())
        self.ends, self.ids = store.open_input_file(name + ".ends"), store.open_input_file(name + ".ids")

    def close(self) -> None:
        self.ends.close()
        self.ids.close()

    def bounds(self, row: int, rows: int) -> np.ndarray:
        """Ends of ``rows`` documents from ``row`` on, with the end before them first."""
        self.ends.seek(8 * max(row - 1, 0))
        found = np.frombuffer(self.ends.read(8 * (rows + (row > 0))), "<u8").astype(np.int64)
        return found if row else np.concatenate(([0], found))

    def read(self, begin: int, end: int) -> bytes:
        self.ids.seek(self.width * begin)
        return self.ids.read(self.width * (end - begin))

    def documents(self, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(key, start in the shard, its ids as unsigned 32-bit numbers) of all documents of ascending ``keys``. Documents that stand
        one behind the other are read together, about FLUSH bytes at once."""
        first, count = self.index.rows(keys)
        rows = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(keys, count)
        cuts = np.flatnonzero(np.diff(rows) != 1) + 1
        for part, own in zip(np.split(rows, cuts), np.split(owner, cuts)):
            for i in range(0, len(part), FLUSH // 8):
                run, names = part[i : i + FLUSH // 8], own[i : i + FLUSH // 8]
                ends = self.bounds(int(run[0]), len(run))
                j = 0
                while j < len(run):
                    stop = max(j + 1, int(np.searchsorted(ends, ends[j] + FLUSH // 4, "right")) - 1)
                    data = np.frombuffer(self.read(int(ends[j]), int(ends[stop])), f"<u{self.width}").astype("<u4")
                    for k in range(j, stop):
                        yield int(names[k]), int(ends[k]), data[int(ends[k] - ends[j]) : int(ends[k + 1] - ends[j])]
                    j = stop


def keyed(keys: DataFrame, files: DataFrame, make, schema: str) -> DataFrame:
    """``make(key, start, ids)`` for every document of the keys (column doc_id), each key sent once to the shards of its range."""
    shards = Shards(files)

    def route(batches):
        for b in batches:
            found = pa.compute.fill_null(b.column(0), NULL_KEY).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shards.of(found)], names=["shard", "key"])

    def read(batches):
        shard, held = None, []

        def close():
            if shard is not None:
                opened = Shard(*shards.paths[shard])
                base = int(shards.base[shard])
                found = opened.documents(np.concatenate(held))
                while rows := [make(None if k == NULL_KEY else k, base + start, data) for k, start, data in islice(found, 1000)]:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                opened.close()

        for b in batches:
            s, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part, own in zip(np.split(s, c := np.flatnonzero(np.diff(s)) + 1), np.split(k, c)):
                if not len(part):
                    continue
                if part[0] != shard:
                    yield from close()
                    shard, held = int(part[0]), []
                held.append(own)
        yield from close()

    types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    target = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    routed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(route, "shard int, key long")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(read, schema)


def read_documents(files: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of ``docs``, each found through its shard's index and read from the files."""
    make = lambda key, start, ids: {"doc_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids)}
    return keyed(docs, files, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids (array<long>) of the documents of the keys in column doc_id: key, ids, one row per stored document."""
    return keyed(keys, files, lambda key, start, ids: {"key": key, "ids": ids.astype(np.int64)}, "key long, ids array<long>")


def op5_token_files(docs: DataFrame) -> DataFrame:
    return read_documents(write_files(docs), docs)
