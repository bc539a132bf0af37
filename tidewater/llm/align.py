"""Alignment of two tokenizers, and how many documents link a pair of ids.

A text with a space before it is cut into pieces where both tokenizers always cut: before a
space or line break that follows something else than white space (no piece of tokenizer B holds
one there, which is checked when it is loaded). A piece's ids, groups and links are worked out
once and remembered by its content, so a document is a sum over its pieces. Groups end where a
token of A and one of B end at the same byte.

Counting takes two passes. The first writes, per task and about ``FLUSH`` pairs, the distinct
pairs and how many documents of it hold each. Distinct pairs are dealt by their A id over shards
of about ``SHARD`` pairs; each shard gets a minimal perfect hash and its keys in order of slot.
Parts of the first table then become dense count vectors by slot, which are summed in a tree of
``FAN`` branches, so no task holds more than two vectors of one shard. The second pass aligns
the documents again and looks pairs up: slot, key verified, count, and whether it is the highest of
its A id (all pairs of an A id are in one shard). A worker holds ``HELD`` shards at most and reads
others again, whatever their number. Shards are files in the shared folder, read through
``pyarrow.fs``; only those that a committed table names are read, so attempts that were lost do
no harm. The driver holds one row per shard. The result is written and the rest deleted.

Defined results: texts that are null, empty, or not the bytes of both tokenizers' tokens (those with
U+2581, for one) have no tokens: zeros and an empty digest, and their pairs count nowhere. Repeated rows
are documents of their own; null ids stay null; ties for the highest count all count; an empty
table gives no rows; extra columns are not read. A group's links are worked out from its distinct ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, mix, scratch, stage
from .token_files import _byte_letters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
PIECES = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
CACHE, LONGEST, TEXT, FLUSH = 300_000, 64, 1 << 20, 2_000_000  # remembered pieces and their code points; code points and pairs at once
TOGETHER, LISTED = 1000, 4096  # pieces encoded at once, links of a group that are listed one by one
SHARD, FAN, HELD = 1 << 17, 8, 24


class _Numbers(dict):
    """New keys get the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


class Aligner:
    """Both tokenizers, the bytes of their tokens, and what is known of the pieces met so far: numbers per piece in
    ``stats``, links one behind the other in ``links`` with their number of times, groups as text."""

    def __init__(self, a: str | None = None, b: str | None = None, cache: int = CACHE):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path(B))
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(rf"\n|[^{SPACE}\s]{SPACE}", name) for name in names):
            raise ValueError("tokenizer B has pieces across the places where texts are cut")
        with open(a or public_tokenizers.path(A), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, letters, first = model["vocab"], {c: i for i, c in _byte_letters().items()}, 256
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged != list(range(first, first + len(merged))):
            raise ValueError("the ids of tokenizer A are not in order of its merges")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < first + len(merged)}
        #: The same merges without special tokens, whose strings are then ordinary text.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [blob for blob, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank, self.cache = self.b.piece_to_id(SPACE), cache
        self.known = _Numbers()
        self.groups: list[bytes] = []
        self.stats, self.whole, self.ends, self.links, self.times = array("q"), array("b"), array("q", [0]), array("q"), array("q")
        self.used, self.extra = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def _forget(self) -> None:
        """Keep the half of the pieces that was used most, long ones not."""
        order = np.argsort(-self.used, kind="stable")[: self.cache // 2]
        names = list(self.known)
        keep = np.sort([i for i in order.tolist() if len(names[i]) <= LONGEST]).astype(np.int64)
        starts, flat = np.array(self.ends), self.spans(keep)
        self.known = _Numbers({names[i]: k for k, i in enumerate(keep.tolist())})
        self.groups = [self.groups[i] for i in keep.tolist()] if self.groups else []
        self.stats = array("q", np.array(self.stats).reshape(-1, 4)[keep].tobytes())
        self.whole = array("b", np.array(self.whole)[keep].tobytes())
        self.links, self.times = (array("q", np.array(x)[flat].tobytes()) for x in (self.links, self.times))
        self.ends = array("q", np.concatenate(([0], np.cumsum(starts[keep + 1] - starts[keep]))).astype(np.int64).tobytes())
        self.used, self.extra, self.size = self.used[keep] // 2, self.extra[keep] if len(self.extra) else self.extra, 0

    def spans(self, pieces: np.ndarray) -> np.ndarray:
        """Places of the links of pieces."""
        ends = np.array(self.ends)
        n = ends[pieces + 1] - ends[pieces]
        return np.arange(n.sum()) + np.repeat(ends[pieces] - np.cumsum(n) + n, n)

    size = 0

    def cut(self, texts: list[str], groups: bool = True) -> list[np.ndarray]:
        """Numbers of the pieces of each text; new pieces are aligned. ``groups``: keep their groups as text."""
        if len(self.known) > self.cache or self.size > 32 * TEXT:
            self._forget()
        first, out, number = len(self.known), [], self.known.__getitem__

        for text in texts:
            pieces = PIECES.findall(" " + text) if text else []
            out.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        new = list(islice(self.known, first, None))
        if new:
            self._learn(new, groups)
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        if out:
            self.used += np.bincount(np.concatenate(out), minlength=len(self.used))
        return out

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B for a text that begins with a space or a line break; None where the tokens are not the bytes."""
        a = self.a.encode_ordinary(text)
        b = [self.blank] if text == " " else self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        blob = text.encode()
        return (a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == blob == b"".join(map(self.b_bytes.__getitem__, b)) else None

    def _learn(self, new: list[str], groups: bool) -> None:
        """Encode new pieces, many at once, since both tokenizers cut between them. A piece that ends with
        white space, or is long, goes alone; so do those of a run whose bytes are not its tokens' bytes."""
        a, b, sizes, run = array("q"), array("q"), np.array([len(p.encode()) for p in new]), []
        whole = np.ones(len(new), bool)

        def put(found: tuple[list[int], list[int]]) -> None:
            a.extend(found[0])
            b.extend(found[1])

        def alone(k: int) -> None:
            if found := self.encode(new[k]):
                put(found)
            else:
                whole[k], sizes[k] = False, 0

        def together() -> None:
            if found := self.encode("".join([new[k] for k in run])) if run else ([], []):
                put(found)
            else:
                for k in run:
                    alone(k)
            run.clear()

        for k, piece in enumerate(new):
            if len(piece) > LONGEST or piece[-1].isspace():
                together()
                alone(k)
                self.size += len(piece) if len(piece) > LONGEST else 0
            else:
                run.append(k)
                if len(run) == TOGETHER:
                    together()
        together()
        self._align(np.array(a), np.array(b), np.cumsum(sizes), whole, groups)

    def _align(self, a: np.ndarray, b: np.ndarray, pieces: np.ndarray, whole: np.ndarray, groups: bool) -> None:
        """Align the tokens of new pieces, which stand one behind the other and end at the bytes ``pieces``."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        upto = lambda found: np.diff(np.searchsorted(found, pieces, "right"), prepend=0)
        stats = np.stack((upto(a_ends), upto(b_ends), upto(ends), np.zeros(len(pieces), np.int64)), axis=1)
        group_piece = np.repeat(np.arange(len(pieces)), stats[:, 2])
        np.add.at(stats[:, 3], group_piece, n_a * n_b)
        large = np.flatnonzero(n_a * n_b > LISTED)
        x, of_x, w_x = self._distinct(a, of_a, large)
        y, of_y, w_y = self._distinct(b, of_b, large)
        n_y = np.bincount(of_y, minlength=len(ends))
        n = n_y[of_x]
        at = np.arange(n.sum()) + np.repeat((np.cumsum(n_y) - n_y)[of_x] - np.cumsum(n) + n, n)
        self.links.frombytes((np.repeat(x, n) << 32 | y[at]).tobytes())
        self.times.frombytes((np.repeat(w_x, n) * w_y[at]).tobytes())
        per = np.bincount(np.repeat(group_piece[of_x], n), minlength=len(pieces)) if len(n) else np.zeros(len(pieces), np.int64)
        self.ends.frombytes((self.ends[-1] + np.cumsum(per)).astype(np.int64).tobytes())
        self.stats.frombytes(stats.astype(np.int64).tobytes())
        self.whole.frombytes(whole.astype(np.int8).tobytes())
        if groups:
            a_text, b_text, i, j, text = [self.a_text[k] for k in a.tolist()], [self.b_text[k] for k in b.tolist()], 0, 0, []
            for p, q in zip(n_a.tolist(), n_b.tolist()):
                text.append(f"{a_text[i]}|{b_text[j]}" if p == 1 == q else f"{','.join(a_text[i : i + p])}|{','.join(b_text[j : j + q])}")
                i, j = i + p, j + q
            i = 0
            for k in stats[:, 2].tolist():
                self.groups.append(";".join(text[i : i + k]).encode())
                i += k

    @staticmethod
    def _distinct(ids: np.ndarray, of: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their groups, times): the ids of large groups once with their number of times."""
        if not len(large):
            return ids, of, np.ones(len(ids), np.int64)
        mine = np.isin(of, large)
        pairs, times = np.unique(np.stack((of[mine], ids[mine])), axis=1, return_counts=True)
        found, groups = np.concatenate((ids[~mine], pairs[1])), np.concatenate((of[~mine], pairs[0]))
        order = np.argsort(groups, kind="stable")
        return found[order], groups[order], np.concatenate((np.ones((~mine).sum(), np.int64), times))[order]


class PairHash:
    """Minimal perfect hash of distinct keys: levels of bits, where a key alone at its place stays. The keys
    that are left after the last level (practically none) are looked up in order; ``keys`` are by slot."""

    LEVELS = 24

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray, rest: int):
        self.levels, self.keys, base = [], keys, 0
        for bits in levels:
            self.levels.append((bits, base + np.cumsum(bits) - bits))
            base += int(bits.sum())
        self.rest = keys[len(keys) - rest :]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0xA24BAED4963EE407)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, depth: int = LEVELS) -> PairHash:
        levels, placed, left = [], [], np.unique(keys)
        while len(left) and len(levels) < depth:
            at = cls.place(left, len(levels), size := max(64, 2 * len(left)))
            alone = np.bincount(at, minlength=size) == 1
            stays = alone[at]
            placed.append(left[stays][np.argsort(at[stays])])
            levels.append(alone)
            left = left[~stays]
        return cls(levels, np.concatenate([*placed, left]).astype(np.int64), len(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, verified; -1 for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self.place(keys[left], level, len(bits))
            out[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        if len(left) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[i] == keys[left], len(self.keys) - len(self.rest) + i, -1)
        hit = out >= 0
        hit[hit] = self.keys[out[hit]] == keys[hit]
        return np.where(hit, out, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.keys), len(self.rest), len(self.levels), *(len(bits) for bits, _ in self.levels)], "<i8")
        return head.tobytes() + b"".join(np.packbits(bits).tobytes() for bits, _ in self.levels) + self.keys.astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> PairHash:
        n, rest, depth = np.frombuffer(data, "<i8", 3).tolist()
        sizes, at, levels = np.frombuffer(data, "<i8", depth, 24).tolist(), 24 + 8 * depth, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels, np.frombuffer(data, "<i8", n, at).astype(np.int64), rest)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """All pairs of an A id are in one shard."""
    return (mix((keys >> 32).astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int32)


def _write(files: str, name: str, data: bytes) -> str:
    """Write a file under a name of this attempt; returns its place."""
    store, root = pafs.FileSystem.from_uri(files)
    store.create_dir(root, recursive=True)
    path = f"{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(f"{root}/{path}") as out:
        out.write(data)
    return f"{files}/{path}"


def _read(path: str) -> bytes:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches sorted by their first column, cut by it."""
    held, shard = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                if shard is not None and keys[x] != shard:
                    yield shard, held
                    held = []
                shard = int(keys[x])
                held.append(batch.slice(x, y - x))
    if held:
        yield shard, held


def _all(parts: list[pa.RecordBatch], column: int) -> np.ndarray:
    return np.concatenate([p.column(column).to_numpy(zero_copy_only=False) for p in parts])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about TEXT code points at once."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held > TEXT:
                yield ids, texts
                ids, texts, held = [], [], 0
        yield ids, texts


_WORKER: dict[str, Aligner] = {}


def aligner_of_process(job: str, a: str | None, b: str | None) -> Aligner:
    """One aligner for all tasks of a job that a Python worker runs."""
    if job not in _WORKER:
        _WORKER.clear()
        _WORKER[job] = Aligner(a, b)
    return _WORKER[job]


def held_pairs(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(key, n): pairs of ids, key = A << 32 | B, and in how many documents of a part of a task each is linked."""
    job = uuid.uuid4().hex

    def run(batches):
        aligner, held, size = aligner_of_process(job, a, b), [], 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for _, texts in _texts(batches):
            cut = aligner.cut(texts, groups=False)
            whole, ends, links = (np.array(x) for x in (aligner.whole, aligner.ends, aligner.links))
            for pieces in cut:
                pieces = np.unique(pieces)
                if len(pieces) and whole[pieces].all():
                    n = ends[pieces + 1] - ends[pieces]
                    held.append(np.unique(links[np.arange(n.sum()) + np.repeat(ends[pieces] - np.cumsum(n) + n, n)]))
                    size += len(held[-1])
                    if size > FLUSH:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    return docs.select(F.lit(0), F.col("text").cast("string")).mapInArrow(run, "key long, n long")


def shards_of(keys: DataFrame, files: str, size: int = SHARD) -> DataFrame:
    """(shard, path, n): minimal perfect hashes of distinct keys, written as files."""
    shards = max(1, -(-keys.count() // size))

    def dealt(batches):
        for batch in batches:
            found = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(found, shards)), pa.array(found)], names=["shard", "key"])

    def build(batches):
        for shard, parts in _runs(batches):
            made = PairHash.build(_all(parts, 1))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": _write(files, f"{shard:06d}-keys", made.dump()), "n": len(made.keys), "shards": shards}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("shards", pa.int32())]))

    rows = keys.select("key").mapInArrow(dealt, "shard int, key long")
    return stage(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, path string, n long, shards int"), "pair-shards")


def counted_shards(pairs: DataFrame, shards: DataFrame, files: str, fan: int = FAN) -> DataFrame:
    """(shard, path, counts): dense counts by slot, summed in a tree, and files of count and whether it is its A id's highest."""
    known = {r["shard"]: (r["path"], r["shards"]) for r in shards.collect()}  # one row per SHARD pairs
    total = next(iter(known.values()))[1] if known else 1
    vector = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def dealt(batches):
        for batch in batches:
            found = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(found, total)), pa.array(found), batch.column(1)], names=["shard", "key", "n"])

    def dense(batches):
        for shard, parts in _runs(batches):
            index = PairHash.load(_read(known[shard][0]))
            counts = np.zeros(len(index.keys), np.int64)
            for part in parts:
                np.add.at(counts, index.slots(part.column(1).to_numpy()), part.column(2).to_numpy())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "part": TaskContext.get().partitionId(), "counts": counts.tobytes()}], schema=vector)

    def summed(batches):
        held = None
        for batch in batches:
            for shard, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[:2] == (shard, part):
                    held[2].__iadd__(np.frombuffer(data, np.int64))
                else:
                    if held:
                        yield pa.RecordBatch.from_pylist([{"shard": held[0], "part": held[1], "counts": held[2].tobytes()}], schema=vector)
                    held = (shard, part, np.frombuffer(data, np.int64).copy())
        if held:
            yield pa.RecordBatch.from_pylist([{"shard": held[0], "part": held[1], "counts": held[2].tobytes()}], schema=vector)

    def written(batches):
        for batch in batches:
            for shard, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                counts, a = np.frombuffer(data, np.int64), PairHash.load(_read(known[shard][0])).keys >> 32
                ids, of = np.unique(a, return_inverse=True)
                most = np.zeros(len(ids), np.int64)
                np.maximum.at(most, of, counts)
                path = _write(files, f"{shard:06d}-counts", counts.astype("<i8").tobytes() + (counts == most[of]).tobytes())
                yield pa.RecordBatch.from_pylist([{"shard": shard, "path": known[shard][0], "counts": path}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("counts", pa.string())]))

    types = "shard int, part int, counts binary"
    rows = pairs.select("key", "n").mapInArrow(dealt, "shard int, key long, n long")
    parts = rows.rdd.getNumPartitions()
    vectors = rows.sortWithinPartitions("shard").mapInArrow(dense, types)
    while parts > 1:
        parts = -(-parts // fan)
        vectors = vectors.withColumn("part", (F.col("part") / fan).cast("int")).repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(summed, types)
    return stage(vectors.mapInArrow(written, "shard int, path string, counts string"), "pair-counts")


class Lookup:
    """Counts of pairs from the shard files; the last ``held`` shards stay in memory."""

    def __init__(self, files: dict[int, tuple[str, str]], shards: int, held: int = HELD):
        self.files, self.shards, self.held, self.open = files, shards, held, OrderedDict()

    def _shard(self, shard: int) -> tuple[PairHash, np.ndarray, np.ndarray]:
        if shard not in self.open:
            while len(self.open) >= self.held:
                self.open.popitem(last=False)
            index, data = PairHash.load(_read(self.files[shard][0])), _read(self.files[shard][1])
            n = len(index.keys)
            self.open[shard] = index, np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.open.move_to_end(shard)
        return self.open[shard]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its A id)."""
        counts, best, own = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), shard_of(keys, self.shards)
        for shard in np.unique(own).tolist():
            at = np.flatnonzero(own == shard)
            index, n, highest = self._shard(shard)
            slots = index.slots(keys[at])
            hit = slots >= 0  # others stand in documents without tokens only
            counts[at[hit]], best[at[hit]] = n[slots[hit]], highest[slots[hit]]
        return counts, best


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def alignments(docs: DataFrame, counts: DataFrame, shards: int, a: str | None = None, b: str | None = None, held: int = HELD) -> DataFrame:
    """Per document its numbers of tokens, groups and links, what the counts say of them, and ``groups`` as text."""
    files, job = {r["shard"]: (r["path"], r["counts"]) for r in counts.collect()}, uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COLUMNS), ("groups_sha256", pa.string())])

    def run(batches):
        aligner = aligner_of_process(job, a, b)
        lookup = aligner.__dict__.setdefault("lookup", Lookup(files, shards, held))
        for ids, texts in _texts(batches):
            cut, known = aligner.cut(texts), len(aligner.extra)
            if known < len(aligner.known):
                begin, n = aligner.ends[known], np.diff(np.array(aligner.ends)[known:])
                counts, best = lookup.of(np.array(aligner.links[begin:]))
                extra, of, times = np.zeros((len(n), 2), np.int64), np.repeat(np.arange(len(n)), n), np.array(aligner.times[begin:])
                np.add.at(extra[:, 0], of, times * best)
                np.add.at(extra[:, 1], of, times * counts)
                aligner.extra = np.concatenate((aligner.extra, extra))
            table = np.concatenate((np.array(aligner.stats).reshape(-1, 4), aligner.extra, 1 - np.array(aligner.whole).reshape(-1, 1)), axis=1)
            rows = []
            for i, pieces in zip(ids, cut):
                found = table[pieces].sum(axis=0).tolist()
                if found[6] or not len(pieces):
                    rows.append((i, 0, 0, 0, 0, 0, 0, ""))
                else:
                    rows.append((i, *found[:6], hashlib.sha256(b";".join(map(aligner.groups.__getitem__, pieces.tolist()))).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", groups_sha256 string")


def op13_align(docs: DataFrame, a: str | None = None, b: str | None = None, shard: int = SHARD, held: int = HELD) -> DataFrame:
    with scratch(docs.sparkSession) as keep:
        files = folder(docs.sparkSession, "pairs")
        pairs = stage(held_pairs(docs, a, b), "held-pairs")
        keys = stage(pairs.select("key").distinct(), "pair-keys")
        shards = shards_of(keys, files, shard)
        counts = counted_shards(pairs, shards, files)
        total = shards.agg(F.max("shards")).first()[0] or 1
        return keep(stage(alignments(docs, counts, total, a, b, held), "alignments"))
