"""Benchmark decontamination by word windows.

The normalised windows of the benchmark (13 words; a shorter item is one window) form a hash set that
is broadcast while it is proven small. Beyond that a bit table of their hashes, of fixed size, is broadcast
instead: it passes few windows but those of the benchmark, and these meet the benchmark's in a join.
Documents are scanned window by window, hash hits are verified word by word, and spans or whole documents
are removed, however large the benchmark is.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window;
an item without id still marks words but is not listed; equal windows of several items count for each;
repeated document rows are judged alike; columns of the input that clash with results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from terrano.llm.arrow_map import LOWER, plain_words, slices, texts, with_arrow_columns
from terrano.session import written

WINDOW = 13
#: Distinct (window, item) rows up to which the hash set is broadcast (about 50 MB).
MAX_BROADCAST_WINDOWS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
#: Bits of the table that stands for a benchmark beyond the bound: 16 MB, whatever the benchmark holds.
_FILTER_BITS = 27
_BLOCK_BITS = 15
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (size, gram, item, h) of the benchmark; gram: the window's words joined by spaces; h: its hash."""
    schema = "size int, gram string, item string, h long"

    def run(batches):
        for batch in slices(batches, 512):
            rows = []
            for it, tx in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                w = plain_words(tx)
                size = min(window, len(w))
                hashes = window_hashes(w, size).view(np.int64).tolist() if w else []
                rows += [(size, b" ".join(w[i : i + size]).decode(), it, h) for i, h in enumerate(hashes)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                ["size", "gram", "item", "h"],
            )

    return benchmark.select(F.col(item).cast("string"), F.col(text)).mapInArrow(run, schema).distinct()


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of every window of ``size`` words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    return WindowSet._hash([h[k : k + n] for k in range(size)]) if n > 0 else np.empty(0, np.uint64)


class WindowSet:
    """The broadcast form: word ids, a bit table over window hashes, and the windows themselves."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for size, gram, item, *_ in rows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in gram.encode().split(b" "))
            self.items.setdefault(size, {}).setdefault(key, set()).update([item] if item is not None else [])
        self.tables = {}
        for size, grams in self.items.items():
            table = np.zeros(1 << _BITS, bool)
            table[self._hash(np.array(list(grams), np.uint64).reshape(-1, size).T) >> np.uint64(64 - _BITS)] = True
            self.tables[size] = table

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(first word, words, items) of each verified window. A word b'' never matches."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        out = []
        for size, table in self.tables.items():
            n = len(ids) - size + 1
            if n <= 0:
                continue
            known = np.concatenate([[0], np.cumsum(ids == 0)])
            starts = np.flatnonzero(known[size:] == known[:-size])  # every word is a benchmark word
            if not len(starts):
                continue
            h = self._hash([ids[starts + k] for k in range(size)])
            grams = self.items[size]
            for at in starts[table[h >> np.uint64(64 - _BITS)]].tolist():
                if (got := grams.get(tuple(ids[at : at + size].tolist()))) is not None:
                    out.append((at, size, got))
        return out


def _verdict(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted) and contaminated (n_hit is a 20th of n_words or more)."""
    grams = item_windows(benchmark, item, item_text, window)
    rows = grams.limit(max_broadcast + 1).collect()  # at most max_broadcast + 1 rows reach the driver
    if len(rows) > max_broadcast:
        return _scan_by_join(docs, grams, text, window, keep_text)
    held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in rows]))

    def make():
        windows = held.value

        def of(batch):
            words, ends, counts = [], [], []
            for tx in texts(batch.column(text)):
                w = plain_words(tx)
                words += w
                words.append(b"")  # no window crosses it
                ends.append(len(words))
                counts.append(len(w))
            change = np.zeros(len(words) + 1, np.int64)
            found: dict[int, set[str]] = {}
            hits = windows.hits(words)
            docs_of = np.searchsorted(ends, [h[0] for h in hits], side="right")
            for (at, size, items), d in zip(hits, docs_of.tolist(), strict=True):
                change[at] += 1
                change[at + size] -= 1
                found.setdefault(d, set()).update(items)
            total = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
            n_hit = (total[ends] - total[[0, *ends[:-1]]]).tolist() if ends else []
            items = [sorted(found.get(i, ())) for i in range(len(ends))]
            return {
                "n_words": counts,
                "n_hit": n_hit,
                "n_items": [len(x) for x in items],
                "items": items,
                "contaminated": [_verdict(h, n) for h, n in zip(n_hit, counts, strict=True)],
            }

        return of

    return with_arrow_columns(docs, REPORT, make, drop=() if keep_text else (text,))


def bit_table(grams: DataFrame) -> np.ndarray:
    """One bit for each hash of the benchmark's windows: at most 4,096 rows of 4 KB reach the driver, whatever their number."""
    bit = F.shiftrightunsigned("h", 64 - _FILTER_BITS)
    rows = grams.groupBy(F.shiftright(bit, _BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg((bit % (1 << _BLOCK_BITS)).cast("long")).alias("bits")).collect()
    table = np.zeros((1 << (_FILTER_BITS - _BLOCK_BITS), 1 << (_BLOCK_BITS - 3)), np.uint8)
    for r in rows:
        table[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _windows_by_join(docs: DataFrame, grams: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(_key, n_words) of every distinct text and (_key, _at, size, item) of its verified windows, for a benchmark beyond the broadcast bound.

    Distinct texts are scanned once, keyed by digest, so that repeated rows multiply nothing.
    """
    grams = written(grams, "grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most `window` values
    held = docs.sparkSession.sparkContext.broadcast(bit_table(grams))
    base = docs.select(_text_key(text).alias("_key"), F.col(text).alias("_text")).groupBy("_key").agg(F.first("_text").alias("_text"))

    def run(batches):
        """(key, size, at, gram) of the windows whose bit is set; size 0 and at: how many words."""
        table = held.value
        for batch in slices(batches, 256):
            for k, tx in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                w = plain_words(tx)
                for size in (0, *sizes):
                    places = np.array([len(w)])
                    if size:
                        h = window_hashes(w, size)
                        bit = h >> np.uint64(64 - _FILTER_BITS)
                        places = np.flatnonzero((table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    for start in range(0, len(places), 10_000):
                        part = places[start : start + 10_000].tolist()
                        n, found = len(part), [b" ".join(w[i : i + size]).decode() for i in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array(part, pa.int64()), pa.array(found, pa.string())],
                            ["_key", "size", "_at", "gram"],
                        )

    windows = written(base.mapInArrow(run, "_key string, size int, _at long, gram string"), "windows")
    return windows.where("size = 0").select("_key", F.col("_at").alias("n_words")), windows.where("size > 0").join(grams, ["size", "gram"]).select("_key", "_at", "size", "item")


def _text_key(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _scan_by_join(docs: DataFrame, grams: DataFrame, text: str, window: int, keep_text: bool) -> DataFrame:
    """As scan(), for a benchmark beyond the broadcast bound."""
    counts, found = _windows_by_join(docs, grams, text)
    hit = found.select("_key", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("size") - 1)).alias("_p")).distinct().groupBy("_key").agg(F.count("*").alias("n_hit"))
    items = found.select("_key", "item").distinct().groupBy("_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    counts = counts.join(hit, "_key", "left").join(items, "_key", "left")
    counts = counts.select(
        "_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("n_items", F.size("items").cast("long"))
    counts = counts.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    clash = [c for c in docs.columns if c in {f.name for f in REPORT.fields}]
    out = docs.drop(*clash).withColumn("_key", _text_key(text)).join(counts, "_key", "left").drop("_key")
    return out if keep_text else out.drop(text)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones; other rows and all columns stay as they are."""
    return scan(docs, benchmark, **options).where(~F.col("contaminated")).select(*docs.columns)


def without_windows(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words from ``first`` on, ``size`` of them, and what stands between those words, for each (first, size)."""
    if not spans:
        return raw
    at = [m.span() for m in _WORD.finditer(raw.translate(LOWER))]
    kept, end = [], 0
    for first, size in sorted(spans):
        a, b = at[first][0], at[first + size - 1][1]
        if a > end:
            kept.append(raw[end:a])
        end = max(end, b)
    return b"".join([*kept, raw[end:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` whose texts lose the words inside benchmark windows, with what stands between those words."""
    grams = item_windows(benchmark, item, item_text, window)
    rows = grams.limit(max_broadcast + 1).collect()  # at most max_broadcast + 1 rows reach the driver
    new = T.StructType([T.StructField(text, T.StringType())])
    if len(rows) <= max_broadcast:
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in rows]))

        def cut(raw: bytes) -> bytes:
            return without_windows(raw, [h[:2] for h in held.value.hits(plain_words(raw))])

        make = lambda: lambda batch: {text: [None if not v else cut(b).decode() for v, b in zip(batch.column(text).is_valid().to_pylist(), texts(batch.column(text)), strict=True)]}
        return with_arrow_columns(docs, new, make).select(*docs.columns)
    _, found = _windows_by_join(docs, grams, text)
    spans = found.select("_key", F.struct("_at", "size").alias("_s")).distinct().groupBy("_key").agg(F.collect_list("_s").alias("_spans"))
    marked = docs.withColumn("_key", _text_key(text)).join(spans, "_key", "left").drop("_key")

    def of(batch):
        spans = [[(x["_at"], x["size"]) for x in s or []] for s in batch.column("_spans").to_pylist()]
        valid = batch.column(text).is_valid().to_pylist()
        return {text: [None if not v else without_windows(b, s).decode() for v, b, s in zip(valid, texts(batch.column(text)), spans, strict=True)]}

    return with_arrow_columns(marked, new, lambda: of, drop=("_spans",)).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    """SHA-256 of the comma-joined list, in hexadecimal; for tests."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
