"""Quality scores by a factorisation machine.

Features: hashed words of the text (weighted by the log of their counts, scaled to unit length), statistics of
its structure, such as lengths, shares of character classes and repeats, in ranges, and numeric metadata columns
(by default the character count that the table states, where it has one), in ranges. Labels, language, source and
id are no features. All statistics are read from the whole text. Every pair of features interacts through vectors of low rank; the sum-of-squares identity scores a document in linear time. Weights are fitted by Adam on a bounded
sample of labelled rows, on the driver, and broadcast; all documents are scored where they lie.

Defined cases: null counts as an empty text and is scored like any other; rows whose label is null or that
have no document are not learnt from; of repeated labels or documents of an id the smallest is learnt from;
equal texts with equal metadata have equal scores; missing or negative metadata is a range of its own; without
labelled rows every score is the prior 0.5; input columns that clash with results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrano.llm.arrow_map import slices, space_words, with_arrow_columns

HASH_BITS = 14
RANK = 8
#: Labelled rows learnt from, at most: those with the smallest hashes of their ids.
MAX_TRAINING_ROWS = 4000
#: Passes over the sample, and steps of 64 rows, at least.
EPOCHS = 12
MIN_STEPS = 500
THRESHOLD = 0.3
FOLDS = 5
SEED = 7
STATS = 16
LEVELS = 12
#: Numeric columns that describe a document, where the table has them; ranges of each, by powers of two.
METADATA = ("n_chars",)
META_LEVELS = 24
FEATURES = (1 << HASH_BITS) + STATS * LEVELS + len(METADATA) * META_LEVELS
_COUNT = re.compile(rb"[.!?]")
_UPPER, _LOWER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#$%&*!|=<>{}_~@/"
#: Words whose hashes a worker keeps at once.
_KEPT_WORDS = 100_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _level(value: float) -> int:
    """A share from 0 to 1 as one of LEVELS ranges, finer near 0."""
    return min(LEVELS - 1, int((max(0.0, value) ** 0.5) * LEVELS))


def structure(text: bytes, words: list[bytes]) -> list[int]:
    """The structure statistics' features: one range of each."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = text.split(b"\n")
    count = text.count
    of = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower = of(_UPPER), of(_LOWER)
    times = Counter(words)
    values = [
        min(1.0, len(words) / 4000),
        min(1.0, len(words) / 100),
        min(1.0, (n / w) / 30),
        len(times) / w,
        upper / max(1, upper + lower),
        min(1.0, 4 * of(_MARKS) / w),
        min(1.0, of(_DIGITS) / n * 4),
        min(1.0, len(_COUNT.findall(text)) / w * 4),
        min(1.0, count(b",") / w * 4),
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / w * 4),
        min(1.0, max(map(len, times), default=0) / 60),
        min(1.0, count(b"|") / w),
        min(1.0, count(b"!") / w),
        max(times.values(), default=0) / w,
        len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
    ]
    first = 1 << HASH_BITS
    return [first + i * LEVELS + _level(v) for i, v in enumerate(values)]


def described(values: tuple) -> list[int]:
    """The metadata's features: one range of each value, by its power of two; the first for missing ones."""
    first = (1 << HASH_BITS) + STATS * LEVELS
    level = lambda v: 0 if v is None or v != v or v < 0 else min(META_LEVELS - 1, 1 + int(v).bit_length())
    return [first + i * META_LEVELS + level(v) for i, v in enumerate(values)]


class _Buckets(dict):
    """Bucket of each word, hashed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word) >> (64 - HASH_BITS)
        return got


_buckets = _Buckets()


def features(texts: list[bytes], metadata: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, features of each text) of the texts' non-zero features, text by text."""
    words = [space_words(t) for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    found = np.fromiter((b for x in words for b in map(_buckets.__getitem__, x)), np.int64, int(sizes.sum()))
    keys, counts = np.unique((np.repeat(np.arange(len(words)), sizes) << HASH_BITS) | found, return_counts=True)
    own, at = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(own, value * value, len(words)))[own]
    more = STATS + len(METADATA)
    fixed = np.array([structure(t, x) + described(m) for t, x, m in zip(texts, words, metadata, strict=True)], np.int64).reshape(-1)
    owner = np.concatenate([own, np.repeat(np.arange(len(words)), more)])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([at, fixed])[order], np.concatenate([value, np.full(len(fixed), 0.5)])[order], np.bincount(owner, minlength=len(words))


def _metadata(batch: pa.RecordBatch) -> list[tuple]:
    names = set(batch.schema.names)
    columns = [batch.column(m).to_pylist() if m in names else [None] * batch.num_rows for m in METADATA]
    return list(zip(*columns, strict=True)) if columns else [()] * batch.num_rows


@dataclass
class Machine:
    """bias, linear weights w and interaction vectors v."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, at: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of several texts: ``sizes`` features each, one at least."""
        first = np.cumsum(sizes) - sizes
        xv = self.v[at] * x[:, None]
        s = np.add.reduceat(xv, first)
        return self.bias + np.add.reduceat(self.w[at] * x, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), first))

    def scores(self, texts: list[bytes], metadata: list[tuple]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(texts, metadata)), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rank: int = RANK, seed: int = SEED) -> Machine:
    """Mini-batch Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, rank)), 0.0
    if not rows:
        return Machine(0.0, w, v * 0)
    y = np.array(labels, float)
    share = min(max(y.mean(), 0.01), 0.99)
    bias = float(np.log(share / (1 - share)))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    step, rate, keep = 0, 0.02, 1e-4
    for _ in range(max(epochs, -(-MIN_STEPS // -(-len(rows) // 64)))):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 64):
            part = order[start : start + 64]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            own = np.repeat(np.arange(len(part)), size)
            xv = v[at] * x[:, None]
            s = np.add.reduceat(xv, first)
            margin = bias + np.add.reduceat(w[at] * x, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), first))
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]
            bias -= rate * float(err.mean())
            g = err[own] * x / len(part)
            used, place = np.unique(at, return_inverse=True)
            gw = np.bincount(place, g, len(used)) + keep * w[used]
            gv = np.zeros((len(used), rank))
            np.add.at(gv, place, g[:, None] * (s[own] - xv))
            gv += keep * v[used]
            step += 1
            for param, grad, m1, m2 in ((w, gw, *state[:2]), (v, gv, *state[2:])):
                m1[used] = 0.9 * m1[used] + 0.1 * grad
                m2[used] = 0.99 * m2[used] + 0.01 * grad * grad
                param[used] -= rate * (m1[used] / (1 - 0.9**step)) / (np.sqrt(m2[used] / (1 - 0.99**step)) + 1e-6)
    return Machine(bias, w, v)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Machine:
    """A machine fitted to at most ``max_rows`` labelled rows outside the held-out fold.

    Their features, not their texts, reach the driver.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    meta = [m for m in METADATA if m in docs.columns]
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *meta).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct("_text", *meta)).alias("_d")).select("_id", "_y", "_d.*")  # one row for each labelled id

    def run(batches):
        for batch in slices(batches, 256):
            at, x, sizes = features([t.encode() if t else b"" for t in batch.column("_text").to_pylist()], _metadata(batch))
            ends = np.cumsum(sizes)[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a.astype("<i4").tobytes() for a in np.split(at, ends)], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for v in np.split(x, ends)], pa.binary()),
                ],
                ["id", "y", "at", "x"],
            )

    got = rows.mapInArrow(run, "id long, y int, at binary, x binary").toArrow()  # at most max_rows rows
    data = sorted(zip(got["id"].to_pylist(), got["at"].to_pylist(), got["x"].to_pylist(), got["y"].to_pylist(), strict=True))
    return fit([(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float)) for _, a, x, _ in data], [y for *_, y in data])


SCORES = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``docs`` with score, the probability of label 1, and predicted, 1 from the threshold on."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = held.value

        def of(batch):
            got = own.scores([t.encode() if t else b"" for t in batch.column(text).to_pylist()], _metadata(batch)).tolist()
            return {"score": got, "predicted": [int(s >= threshold) for s in got]}

        return of

    return with_arrow_columns(docs, SCORES, make, drop=() if keep_text else (text,), rows=128)


def accepted(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, with all columns."""
    return score(docs, machine, text, threshold).where("predicted = 1").select(*docs.columns)


def crc_fold(doc_id: int) -> int:
    """fold() in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
