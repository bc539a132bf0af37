"""Fill-in-middle transformation with memoised content-defined chunks.

A text is cut into chunks where a rolling (gear) hash of the 32 bytes before a place has
``BITS`` low zero bits, at least ``LEAST`` and at most ``MOST`` bytes apart and never inside a
character, so equal passages give equal chunks wherever they stand. A chunk's summary
(code points, tokens, whether it begins and ends with a letter) is kept per Python worker under
the chunk's bytes: a hit is verified by content. Summaries combine: the tokens of neighbouring
chunks add up, less one where a word runs over the border. So a document's tokens are counted
from summaries, and only the two chunks that hold a cut are cut into tokens.

A worker keeps two generations of at most ``CACHE`` summaries; texts are hashed ``BLOCK`` bytes at
a time. No row leaves its task, so there is no shuffle and a lost executor costs its tasks only.

Defined results: null text is empty; an empty text is plain with n = 0 and the digest of the empty
string; a null doc_id is hashed as no digits (``1:``); repeated rows stay repeated; an empty table
gives no rows; a word or a run of bytes without a cut of its own, however long, is chunked at
``MOST`` bytes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tokens, the marks, and the shares in hundredths.
TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOVED, REVERSED = 90, 20

WINDOW, BITS, LEAST, MOST = 32, 9, 64, 4096
CACHE, BLOCK = 50_000, 1 << 20
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_LOW = np.uint32((1 << BITS) - 1) << np.uint32(32 - BITS)
#: Letters to a, other first bytes of characters to a dot; the bytes that go on are deleted.
_KIND = bytes(ord("a") if chr(b).isalpha() and b < 128 else ord(".") for b in range(256))
_GOES_ON = bytes(range(128, 192))


def _places(raw: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash has the zero bits; the hash of a window needs all its bytes.
    Sums of 1, 2, 4, ... bytes double up to the window: h(2k, i) = h(k, i) + (h(k, i - k) << k)."""
    found = []
    for at in range(0, len(raw), BLOCK):
        first = max(0, at - WINDOW + 1)
        h, k = _GEAR[raw[first : at + BLOCK]], 1
        while k < WINDOW:
            longer = h.copy()
            longer[k:] += h[:-k] << np.uint32(k)
            h, k = longer, 2 * k
        hits = np.flatnonzero((h & _LOW) == 0) + first + 1
        found.append(hits[(hits > at) & (hits >= WINDOW)])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def chunk_ends(blob: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8."""
    out, last, n = [], 0, len(blob)

    def whole(i: int) -> int:
        while i < n and 128 <= blob[i] < 192:
            i += 1
        return i

    places = _places(np.frombuffer(blob, np.uint8)).tolist() if n > LEAST else []
    for place in [*places, n]:
        while place - last > MOST:
            last = whole(last + MOST)
            out.append(last)
        place = whole(place)
        if place - last >= LEAST and place < n:
            out.append(place)
            last = place
    if n > last:
        out.append(n)
    return out


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(code points, tokens, begins with a letter, ends with a letter)."""
    kinds = chunk.translate(_KIND, _GOES_ON)
    begins = kinds[:1] == b"a"
    return len(kinds), kinds.count(b".") + kinds.count(b".a") + begins, begins, kinds[-1:] == b"a"


class Memo:
    """Summaries by content, in two generations."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old, self.made = size, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = summary(chunk)
                self.made += 1
            if len(self.new) >= self.size:
                self.new, self.old = {}, self.new
            self.new[chunk] = found
        return found


class Counted:
    """A text with the combined summaries of its chunks."""

    def __init__(self, text: str, memo: Memo):
        self.chunks, self.chars, self.tokens, self.joined = [], [0], [0], []
        blob, begin, letter = text.encode("utf-8"), 0, False
        for end in chunk_ends(blob):
            chunk = blob[begin:end]
            chars, tokens, begins, ends = memo.of(chunk)
            joined = letter and begins
            self.chunks.append(chunk)
            self.joined.append(joined)
            self.chars.append(self.chars[-1] + chars)
            self.tokens.append(self.tokens[-1] + tokens - joined)
            begin, letter = end, ends
        self.n = self.tokens[-1]

    def start(self, k: int) -> int:
        """Code point at which token ``k`` begins; the text's end for k = n."""
        if k >= self.n:
            return self.chars[-1]
        i = int(np.searchsorted(self.tokens, k, "right")) - 1
        own = k - self.tokens[i] + self.joined[i]
        return self.chars[i] + next(islice(TOKEN.finditer(self.chunks[i].decode("utf-8")), own, None)).start()


def transform(doc_id: int | None, text: str, memo: Memo) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix and middle in code points, output) of one document."""
    counted = Counted(text, memo)
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= MOVED:
        return counted.n, "plain", None, None, text
    low, high = sorted((h1 % (counted.n + 1), h2 % (counted.n + 1)))
    a, b = counted.start(low), counted.start(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < REVERSED:
        return counted.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return counted.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_MEMO = Memo()


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the whole ``output`` of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((key, *transform(key, text.as_py() or "", _MEMO)))
                held += len(rows[-1][-1])
                if held > 4 * BLOCK:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    kinds = [pa.string() if f.name == "output" else f.type for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, from output and form alone. Marks can't overlap, and
    texts with a mark are plain, so the first mark of each kind is the one that was put there."""

    def part(opens: str, closes: str | None) -> Column:
        begin = F.locate(opens, output) + len(opens)
        length = F.locate(closes, output) - begin if closes else F.length(output)
        return F.substring(output, begin, length)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(docs: DataFrame) -> DataFrame:
    out = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Tokens as a list; prefix and middle as its joined slices; ``restored`` is the text itself.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    k AS (SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS p, CAST('0x' || h[25:32] AS BIGINT) % 100 AS r FROM d),
    f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 90 THEN 'plain' WHEN r < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(t[1:least(a, b)], '') AS x, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS y, array_to_string(t[greatest(a, b) + 1:], '') AS z FROM k)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
