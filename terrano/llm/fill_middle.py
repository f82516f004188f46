"""Fill-in-the-middle transformation with content-defined chunk memoisation.

A text is cut into units (a word with the white space before it; white space at the end is a unit of its own)
and two of the n + 1 borders between units split it into prefix, middle and suffix. Where the borders lie needs
only counts, so

1. a rolling hash over the last 32 bytes cuts texts into chunks where the hash's top bits are zero: a passage
   that several documents share gives the same chunks in all of them, wherever it stands,
2. each distinct chunk is summarised once and kept under its content, which every hit is compared with: code
   points, words, and whether it begins and ends inside a word,
3. summaries combine: words that run on from one chunk into the next count once, so running sums give the unit
   count of the text, the chunk that holds a border, and the code points before it; only the chunks that hold
   the two borders are read again.

``invert`` rebuilds the exact text from output and form: the marks cannot occur in a transformed text, and none
of them overlaps itself, so the first mark of each kind is the one that was put there.

Defined cases: a null text counts as empty and is plain; a null id counts as the empty string in the hash; texts
that hold a mark are plain; white space alone is one unit; repeated rows are transformed alike; columns of the
input named as new ones are replaced; an empty table gives an empty table. A chunk without a border (one byte
repeated, say) may be as long as its text: it is summarised like any other, but chunks of more than 65,536 bytes
are not kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrano.llm.arrow_map import texts, with_arrow_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WHITE = b" \t\n\v\f\r"
#: Top bits of the rolling hash that are zero at a border: chunks of about 256 bytes.
CHUNK_BITS = 8
#: Bytes that the rolling hash looks back.
REACH = 32
MAX_KEPT_BYTES = 1 << 26
MAX_KEPT_CHUNK = 1 << 16
SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
_WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: A fixed number for each byte, for the rolling hash.
_BYTE_CODES = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


def cuts(raw: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Where the text's chunks end, its own end included: behind bytes where the hash of the last 32 begins with ``bits`` zeros, moved on to the next code point."""
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    hashed = _BYTE_CODES[data]
    width = 1
    while width < REACH:  # sums of codes shifted by their age: each pass doubles the window
        older = np.zeros_like(hashed)
        older[width:] = hashed[:-width] << np.uint32(width)
        hashed = hashed + older
        width *= 2
    # older codes are shifted further, so only the top bits depend on the whole window
    ends = np.flatnonzero(hashed >> np.uint32(32 - bits) == 0) + 1
    ends = ends[ends < len(data)]
    while len(inside := np.flatnonzero(data[ends] & 0xC0 == 0x80)):  # not within a code point
        ends[inside] += 1
        ends = ends[ends < len(data)]
    return [*np.unique(ends).tolist(), len(raw)]


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(code points, words, begins inside a word, ends inside a word)."""
    return len(chunk.decode("utf-8", "replace")), len(chunk.split()), chunk[0] not in WHITE, chunk[-1] not in WHITE


class Memo:
    """Summaries of the chunks a worker has met, by content."""

    def __init__(self, max_bytes: int = MAX_KEPT_BYTES, bits: int = CHUNK_BITS) -> None:
        self.max_bytes, self.bits = max_bytes, bits
        self.kept: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.held = self.met = self.made = 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.met += 1
        found = self.kept.get(chunk)  # equal content, not only an equal hash
        if found is None:
            found = summary(chunk)
            self.made += 1
            if len(chunk) <= MAX_KEPT_CHUNK:
                if self.held + len(chunk) > self.max_bytes:
                    self.kept, self.held = {}, 0
                self.kept[chunk] = found
                self.held += len(chunk)
        return found

    def borders(self, raw: bytes) -> Borders:
        return Borders(raw, self)


class Borders:
    """The units of a text, from its chunks' summaries. ``n`` units; ``place(k)`` is the border behind the k-th."""

    def __init__(self, raw: bytes, memo: Memo) -> None:
        self.raw, self.ends = raw, cuts(raw, memo.bits)
        starts = [0, *self.ends[:-1]] if raw else []
        parts = [memo.of(raw[a:b]) for a, b in zip(starts, self.ends, strict=True)]
        chars, words, begins, stops = (np.array(x, np.int64) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        self.starts = np.array(starts, np.int64)
        self.chars_before = np.concatenate([[0], np.cumsum(chars)])
        # words that end at a chunk's first byte: the chunk before stops inside one, and this begins with white space
        self.at_start = np.zeros(len(parts), np.int64)
        self.at_start[1:] = (stops[:-1] == 1) & (begins[1:] == 0)
        # words that end within a chunk are those that white space follows in it
        self.ended = np.cumsum(self.at_start + words - stops) if parts else np.zeros(0, np.int64)
        self.open = bool(parts) and bool(stops[-1])
        words_in_all = (int(self.ended[-1]) if parts else 0) + self.open
        self.n = words_in_all + (bool(parts) and not self.open)

    def place(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the border."""
        if k <= 0 or not len(self.ended):
            return 0, 0
        if k >= self.n or k > self.ended[-1]:
            return len(self.raw), int(self.chars_before[-1])
        c = int(np.searchsorted(self.ended, k))
        left = k - (int(self.ended[c - 1]) if c else 0) - int(self.at_start[c])
        start = int(self.starts[c])
        if not left:
            return start, int(self.chars_before[c])
        chunk = self.raw[start : self.ends[c]]
        for found in _WORD_END.finditer(chunk):
            left -= 1
            if not left:
                return start + found.end(), int(self.chars_before[c]) + len(chunk[: found.end()].decode("utf-8", "replace"))
        raise AssertionError("a chunk holds fewer words than its summary says")


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arranged(raw: bytes, doc_id: int | None, memo: Memo, rate: int = 50, suffix_first: int = 80, seed: int = 42) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, code points of prefix and middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    borders = memo.borders(raw)
    if not raw or h3 % 100 >= rate or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return borders.n, "plain", None, None, raw
    a, b = sorted((h1 % (borders.n + 1), h2 % (borders.n + 1)))
    (one, one_chars), (two, two_chars) = borders.place(a), borders.place(b)
    prefix, middle, suffix = raw[:one], raw[one:two], raw[two:]
    form = "spm" if h4 % 100 < suffix_first else "psm"
    out = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return borders.n, form, one_chars, two_chars - one_chars, out


def transform(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    rate: of a hundred documents so many are not plain; suffix_first: of a hundred of these so many are spm, the rest psm.
    """

    def make():
        memo = Memo()

        def of(batch: pa.RecordBatch) -> dict:
            rows = [arranged(t, d, memo, rate, suffix_first, seed) for d, t in zip(batch.column(doc_id).to_pylist(), texts(batch.column(text)), strict=True)]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in SCHEMA.names]
            columns[-1] = [x.decode("utf-8", "replace") for x in columns[-1]]
            return dict(zip(SCHEMA.names, columns, strict=True))

        return of

    return with_arrow_columns(docs, SCHEMA, make, drop=() if keep_text else (text,), rows=64)


def invert(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))

    def between(mark: Column) -> tuple[Column, Column]:
        body = F.substr(output, F.lit(4))
        at = F.instr(body, mark)
        head, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + 3)
        to = F.instr(rest, m)
        return head, F.struct(F.substr(rest, F.lit(1), to - 1).alias("part"), F.substr(rest, to + 3).alias("middle"))

    prefix, after_prefix = between(s)
    suffix, after_suffix = between(p)
    return (
        F.when(form == "psm", F.concat(prefix, after_prefix["middle"], after_prefix["part"]))
        .when(form == "spm", F.concat(after_suffix["part"], after_suffix["middle"], suffix))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = transform(docs.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(invert(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
