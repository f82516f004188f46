"""Mixture-controlled packing into fixed windows of tokens.

Each source is a queue: the stream of its documents' tokens, however many sources there are. Windows are
filled by deficit round-robin in quanta of ``quantum`` tokens. A round is one window's worth of credit,
dealt to the queues in their target proportions; a queue is served a quantum whenever its deficit counter
holds one, in order of name within the round, and carries the rest of its deficit to the next round. The
counters start at half a quantum, so after every round a queue that still holds tokens has been served its
target within half a quantum. How much a queue has been served after r rounds has a closed form, hence so
has the place of any quantum: deficits carry across windows and partitions without a sequential pass. What
is left of each queue below a quantum is packed end to end behind all quanta, so only the last window can
be short.

A window holds the mixture as closely as its quanta are fine: of S queues each lacks or exceeds its target by a
third of a quantum on average. So the quantum is chosen from the number of queues, as the largest power of two
at which these thirds come to ``DEVIATION`` of a window, but ``FINEST`` tokens at least and ``COARSEST`` at
most: with 20 queues of a 1024-token window 8 tokens. With more than about a hundred queues no window can hold them all in
proportion; then proportions hold over as many windows as ``FINEST`` asks for.

Up to ``max_held`` queues every task holds all totals and finds places by the closed form; beyond that the
quanta are ranked by a distributed sort on the same rounds. Both give the same windows.

Defined cases: a null text counts as empty (one end id); a null source is the queue ''; weights are
numbers of any kind and need not sum to one; queues of weight 0, and those that given weights do not name,
follow behind the others in order of name; negative or non-finite weights are refused; repeated rows are
packed as often as they occur; an empty table gives no piece; other columns of the input are not returned.
"""

from __future__ import annotations

import base64
import math
import zlib
from fractions import Fraction
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.llm.arrow_map import slices
from terrano.session import broadcast_within, written

WINDOW = 1024
COARSEST, FINEST = 256, 4
#: Tokens of a window that may lie off its target proportions on average, as a share of the window.
DEVIATION = 0.1
END_ID = 0
#: Queues up to which each task holds all totals.
MAX_HELD_QUEUES = 4096
#: Rows of (queue, partition) totals up to which they are broadcast (about 40 MB).
MAX_BROADCAST_TOTALS = 1_000_000
#: Quanta that one row of the distributed ranking stands for before it is exploded.
CHUNK = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SPECIAL = "<|endoftext|>"
_encoders: dict[str, tiktoken.Encoding] = {}


def vocabulary_path() -> str:
    """The default vocabulary: the same ids as the tokenizer file byte_bpe_50k.json."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ranks file, once per Python worker."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})
    return _encoders[path]


def quantum_for(queues: int, window: int = WINDOW) -> int:
    """Tokens of a quantum for so many queues: a power of two that divides the window."""
    quantum = 1
    while quantum * 2 <= COARSEST and window % (quantum * 2) == 0 and (quantum * 2 <= FINEST or quantum * 2 * queues <= 3 * DEVIATION * window):
        quantum *= 2
    return quantum


def token_ids(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids as the tokenizers library gives them without added special tokens."""
    return enc.encode(text, allowed_special="all") if _SPECIAL in text else enc.encode_ordinary(text)


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, queue, part, at, n, ids: the ids as 2-byte words (4 for vocabularies beyond them) and the place in the part's stream of the queue."""

    def run(batches):
        enc, part, ends = encoder(path), TaskContext.get().partitionId(), {}
        kind = "<u2" if enc.n_vocab <= 1 << 16 else "<u4"
        for batch in slices(batches, 256):
            ids, at, n = [], [], []
            queues = batch.column(1).to_pylist()
            for q, t in zip(queues, batch.column(2).to_pylist(), strict=True):
                got = token_ids(enc, t) if t else []
                got.append(END_ID)
                ids.append(np.array(got, kind).tobytes())
                at.append(ends.get(q, 0))
                n.append(len(got))
                ends[q] = at[-1] + len(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "at", "n", "ids"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("queue"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, queue string, part int, at long, n long, ids binary")


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers in the same proportions, zeros left out."""
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    exact = {q: Fraction(str(w)) for q, w in weights.items() if w > 0}
    scale = math.lcm(*(f.denominator for f in exact.values())) if exact else 1
    return {q: int(f * scale) for q, f in exact.items()}


class Schedule:
    """Where each quantum of each queue goes. ``totals``: tokens by queue; ``weights``: target proportions, by default the totals' own."""

    def __init__(self, totals: dict[str, int], window: int = WINDOW, quantum: int = COARSEST, weights: dict[str, float] | None = None) -> None:
        if window % quantum:
            raise ValueError("the quantum must divide the window")
        self.names = sorted(totals)
        self.window, self.quantum = window, quantum
        full = [totals[q] // quantum for q in self.names]
        given = whole_weights(weights) if weights is not None else dict(zip(self.names, full, strict=True))
        shares = [given.get(q, 0) for q in self.names]
        self.sum = sum(shares)  # a round deals window // quantum quanta over this sum
        top = max([0, *shares]) * (window // quantum)
        most = max([0, *(-(-(2 * n + 1) * self.sum // (2 * s)) for n, s in zip(full, shares, strict=True) if s)])
        self.kind = object if 2 * most * top + self.sum >= 1 << 62 else np.int64
        self.full = np.array(full, np.int64)
        self.credit = np.array([s * (window // quantum) for s in shares], self.kind)
        # queues without a share follow behind
        self.behind = np.array([s == 0 for s in shares], bool)
        ahead = int(self.full[~self.behind].sum()) if full else 0
        self.behind_at = ahead + np.concatenate([[0], np.cumsum(np.where(self.behind, self.full, 0))])[:-1].astype(np.int64)
        first = sum(full) * quantum
        self.rest_at = [first + x for x in accumulate((totals[q] % quantum for q in self.names), initial=0)][:-1]
        self.index = {q: i for i, q in enumerate(self.names)}

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """(rounds, queues): quanta served by the end of each round."""
        got = (2 * rounds[:, None] * self.credit[None] + self.sum) // (2 * max(1, self.sum))
        return np.minimum(got, self.full[None])

    def slots(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place among all quanta of the k-th of a queue: those of earlier rounds, and in its round those of earlier queues."""
        out = np.empty(len(k), np.int64)
        late = self.behind[queue]
        out[late] = self.behind_at[queue[late]] + k[late]
        step = max(1, 2_000_000 // max(1, len(self.names)))
        on = np.flatnonzero(~late)
        for at in range(0, len(on), step):
            part = on[at : at + step]
            i, own = queue[part], k[part].astype(self.kind)
            credit = self.credit[i]
            rounds = -(-((2 * own + 1) * self.sum) // (2 * credit))
            now, then = self.served(rounds), self.served(rounds - 1)
            before = np.arange(len(self.names))[None] < i[:, None]
            others = np.where(before, now, then)
            others[np.arange(len(part)), i] = 0
            others[:, self.behind] = 0
            out[part] = (others.sum(1) + own).astype(np.int64)
        return out


def cut(n: int, at: int, full: int, rest_at: int, slots: list[int], window: int, quantum: int) -> list[tuple[int, int, int]]:
    """(first token, tokens, place in the packed stream) of a document that begins at ``at`` in its queue; slots: of its quanta in order."""
    out: list[tuple[int, int, int]] = []
    end, first = at + n, at // quantum
    for k, slot in enumerate(slots, first):
        a, b = max(at, k * quantum), min(end, (k + 1) * quantum)
        to = slot * quantum + a - k * quantum
        if out and out[-1][2] + out[-1][1] == to and to % window:
            out[-1] = (out[-1][0], out[-1][1] + b - a, out[-1][2])
        else:
            out.append((a - at, b - a, to))
    a = max(at, full * quantum)
    while a < end:
        to = rest_at + a - full * quantum
        b = min(end, a + window - to % window)
        out.append((a - at, b - a, to))
        a = b
    return out


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in an order without ties. Sorted by ranges; only sums by range reach the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.sum(value).alias("n")).collect()}  # one row a range
    starts, at = [], 0
    for p in sorted(sums):
        starts.append((p, at))
        at += sums[p]
    before = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part int, _first long"))
    inside = dealt.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inside.join(first, "_part").withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_first")


def ranked(totals: DataFrame, window: int, quantum: int, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """(queue, k, slot) of all quanta, (queue, full, rest_at) of all queues: as Schedule, by sorting instead of holding all totals."""
    full = F.floor(F.col("n") / quantum).cast("long")
    rows = totals.select("queue", full.alias("full"), (F.col("n") % quantum).alias("rest"))
    if weights is None:
        rows = rows.withColumn("share", F.col("full"))
    else:
        named = totals.sparkSession.createDataFrame(list(whole_weights(weights).items()) or [("", 0)], "queue string, share long")
        rows = rows.join(F.broadcast(named), "queue", "left").withColumn("share", F.coalesce("share", F.lit(0)))
    rows = written(rows, "queues")
    whole = lambda c: c.cast("decimal(38,0)")
    got = rows.agg(F.sum("share").alias("s"), F.sum("full").alias("f")).first()
    total, quanta = got["s"] or 0, got["f"] or 0
    chunks = rows.where("full > 0").select("queue", "share", "full", F.explode(F.sequence(F.lit(0), F.floor((F.col("full") - 1) / CHUNK))).alias("c"))
    # a hot queue's chunks are dealt out before they become quanta
    chunks = chunks.repartition(int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions")), "queue", "c")
    each = chunks.select("queue", "share", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("full")) - 1)).alias("k"))
    due = F.expr(f"((2 * cast(k as decimal(38,0)) + 1) * {total} + 2 * cast(share as decimal(38,0)) * {window // quantum} - 1) div (2 * cast(share as decimal(38,0)) * {window // quantum})")
    each = each.select("queue", "k", F.when(F.col("share") > 0, whole(due)).otherwise(F.lit("9" * 37).cast("decimal(38,0)")).alias("round"))
    slots = running_total(each, ["round", "queue", "k"], F.lit(1).cast("long"), "slot").select("queue", "k", "slot")
    rests = running_total(rows, ["queue"], F.col("rest"), "rest_at").select("queue", "full", (F.col("rest_at") + quanta * quantum).alias("rest_at"))
    return slots, rests


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    quantum: int | None = None,
    weights: dict[str, float] | None = None,
    max_broadcast: int = MAX_BROADCAST_TOTALS,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_held: int = MAX_HELD_QUEUES,
) -> DataFrame:
    """One row per piece (PIECES; with ``ids`` array if asked for). ``quantum``: by default chosen from the number of queues.

    Tokenised once and written; at most ``max_held`` totals by queue reach the driver.
    """
    tokens = written(tokenize(docs, vocabulary or vocabulary_path(), doc_id, text, source), "tokens")
    sums = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "totals")
    by_queue = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    held = by_queue.limit(max_held + 1).collect()  # bounded
    quantum = quantum or quantum_for(len(held) if len(held) <= max_held else by_queue.count(), window)
    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(broadcast_within(base, max_broadcast), ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    if len(held) <= max_held:
        plan = Schedule({r["queue"]: r["n"] for r in held}, window, quantum, weights)
        rows = placed.withColumn("slots", F.lit(None).cast("array<long>")).withColumn("full", F.lit(None).cast("long")).withColumn("rest_at", F.lit(None).cast("long"))
    else:
        plan = None
        slots, rests = ranked(written(by_queue, "queues"), window, quantum, weights)
        placed = written(placed.join(rests, "queue"), "placed")
        need = placed.select("queue", "at", F.explode(F.sequence(F.floor(F.col("at") / quantum), F.floor((F.col("at") + F.col("n") - 1) / quantum))).alias("k"))
        got = need.join(slots, ["queue", "k"]).groupBy("queue", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"]).alias("slots"))
        rows = placed.join(got, ["queue", "at"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<long>")))

    def run(batches):
        for batch in slices(batches, 256):
            cols = {c: batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")}
            if plan is not None:
                queue = np.array([plan.index[q] for q in batch.column("queue").to_pylist()], np.int64)
                at, n = (np.array(cols[c], np.int64) for c in ("at", "n"))
                full, rest_at = plan.full[queue], [plan.rest_at[i] for i in queue]
                first = at // quantum
                count = np.maximum(np.minimum((at + n - 1) // quantum + 1, full) - first, 0)
                k = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                found = plan.slots(np.repeat(queue, count), k).tolist()
                ends = np.cumsum(count).tolist()
                lists = [found[e - c : e] for e, c in zip(ends, count.tolist(), strict=True)]
                full = full.tolist()
            else:
                lists, full, rest_at = (batch.column(c).to_pylist() for c in ("slots", "full", "rest_at"))
            rows, parts = [], []
            for d, at, n, raw, own, f, r in zip(*cols.values(), lists, full, rest_at, strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                whole = ids.tobytes()
                for start, length, to in cut(n, at, f, r, own, window, quantum):
                    rows.append((d, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), n, to // window, to % window))
                    if with_ids:
                        parts.append(ids[start : start + length].tolist())
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
