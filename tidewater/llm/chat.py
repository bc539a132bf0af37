"""Chat formatting as a prefix tree.

Conversations are ordered by the digests of their turns, so those that share
initial turns are neighbours, and walking them in that order is a depth-first
walk of their prefix tree. Each shard (one task's range) holds the walk as rows:
a conversation adds only the turns that the one before it lacks. A new turn has
its place in the shard's token stream, the position id of its first token, and
the stream intervals of its ancestors, which are all that its tokens attend to.
A token is one code point of formatted text. Shared turns stand once in a shard,
and a shard begins with its whole first path, so it can be read alone.

Template: ``### role: text</turn>`` and a line end; backslash, ``#`` and ``<``
in texts (and ``:`` in roles) are escaped by a backslash, so no text can forge a
control string. The loss mask covers assistant texts.

A conversation is one record and fits a task; copies of conversations and shared
first turns may be any number. Defined results: null text or role is empty; ties
of ``turn`` go by role, then text, null turns first; repeated rows are repeated
turns; a row with a null conv_id belongs to no known conversation and is one of its own,
so that such rows never meet in one record; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

CONTROL = (-7, "\\### Assistant: </turn> ok")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, more: str = "") -> str:
    for c in "\\#<" + more:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn and where its text begins and ends in it."""
    head, body = f"### {escape(role, ':')}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at code point {at}")
    return turns


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, path): a conversation's turns in order, and their digests joined."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    turns = clean.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.unionAll(clean.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    path = F.transform("turns", lambda t: F.md5(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text).cast("binary")))
    return turns.select("conv_id", "turns", F.concat_ws("", path).alias("path"))


SEGMENT = "struct<text:string,start:long,position:long,loss_start:int,loss_end:int>"
STREAM = f"shard int, seq long, conv_id long, keep int, ancestors array<struct<start:long,end:long>>, segments array<{SEGMENT}>"


def write_stream(rows: DataFrame) -> DataFrame:
    """Write the depth-first token stream and return the written table, a row per conversation."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = gather(rows).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    segment = pa.struct([("text", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("keep", pa.int32()), ("ancestors", pa.list_(span)), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, at = TaskContext.get().partitionId(), 0, 0
        stack: list[tuple[str, int, int]] = []  # digest, start, end of each turn on the current path
        for b in batches:
            out = []
            for conv, turns, path in zip(b.column(0), b.column(1), b.column(2)):
                turns, path = turns.as_py(), path.as_py()
                keys = [path[i : i + 32] for i in range(0, len(path), 32)]
                keep = 0
                while keep < min(len(stack), len(keys)) and stack[keep][0] == keys[keep]:
                    keep += 1
                del stack[keep:]
                ancestors: list[dict] = []
                for _, s, e in stack:
                    if ancestors and ancestors[-1]["end"] == s:
                        ancestors[-1]["end"] = e
                    else:
                        ancestors.append({"start": s, "end": e})
                position, segments = sum(e - s for _, s, e in stack), []
                for key, t in zip(keys[keep:], turns[keep:]):
                    text, a, z = render(t["role"], t["text"])
                    own = t["role"] == "assistant"
                    segments.append({"text": text, "start": at, "position": position, "loss_start": a if own else 0, "loss_end": z if own else 0})
                    stack.append((key, at, at + len(text)))
                    at, position = at + len(text), position + len(text)
                out.append({"shard": shard, "seq": seq, "conv_id": conv.as_py(), "keep": keep, "ancestors": ancestors, "segments": segments})
                seq += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stage(ordered.mapInArrow(run, STREAM), "chat-stream")


def read_stream(stream: DataFrame) -> DataFrame:
    """Rebuild each conversation from its shard and digest it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(stack: list[dict]) -> list:
        turns = parse("".join(s["text"] for s in stack))
        loss = "".join(unescape(s["text"][s["loss_start"] : s["loss_end"]]) for s in stack)
        return [len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(s["text"]) for s in stack)]

    def run(batches):
        shard, stack, last = None, [], None
        for b in batches:
            out = []
            for number, conv, keep, segments in zip(*(b.column(i) for i in range(4))):
                if number.as_py() != shard:
                    shard, stack, last = number.as_py(), [], None
                new = segments.as_py()
                if new or last is None or keep.as_py() != len(stack):
                    stack = stack[: keep.as_py()] + new
                    last = digest(stack)
                out.append([conv.as_py(), *last])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    ordered = stream.repartition("shard").sortWithinPartitions("shard", "seq").select("shard", "conv_id", "keep", "segments")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and the control conversation -7, formatted and read back."""
    conv, text = CONTROL
    more = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read_stream(write_stream(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
