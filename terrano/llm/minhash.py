"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles. Documents of equal sets form a class; classes are
compared, never copies. Each class keeps the k smallest hashes of its set.

1. Inverted lists: classes that retain a value form its list. Lists of up to ``list_limit`` classes give
   their pairs directly (linear in the rows) and the overlaps of a pair are counted over its lists.
2. Longer lists (a passage or a large group of copies) give no pairs of their own. A pair that shares no
   short list must consist mostly of values in long lists on both sides; such classes, and only those,
   go to buckets of two retained values each. A bucket of any size is linked through pivots: all members
   against one, then against those that are still in another component than most, until none is left.
   Blocks of members meet blocks of pivots, on their full sets.
3. The similarity of a listed pair is estimated from the union of both sketches, and pairs that may reach
   the threshold are verified on the full sets of the texts, as sets of 64-bit hashes of their shingles; classes
   are told apart by 128-bit digests of these. Pairs already in one component are skipped.
4. Components are found by joins that shorten paths; nothing but counts reaches the driver.

Defined cases: null or wordless texts have an empty set, are linked with nothing and form a component of
their own; rows without id are never linked, have a null component and stay (kept); rows that repeat an id
are judged each by its text; copies share a component whose smallest id stays; an empty table gives an
empty result; other columns are kept unless they clash with results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from terrano.llm.arrow_map import slices, space_words, texts
from terrano.session import broadcast_within, join_hot, written

SHINGLE = 5
PERCENT = 75
SKETCH = 48
LIST_LIMIT = 40
BUCKETS = 16
#: Values in long lists up to which they are broadcast.
MAX_BROADCAST_VALUES = 500_000
#: Pivots a bucket gets in a round after the first; what is left follows in the next.
MAX_PIVOTS = 512
#: Parts that a bucket's pivots are drawn from, each in a task of its own.
SALTS = 64
#: Nodes with links up to which labels are broadcast (about 20 MB).
MAX_BROADCAST_NODES = 400_000
#: Members of a bucket in one task's block.
BLOCK = 500
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it is shorter."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _A
        out ^= out >> np.uint64(32)
    out = (out ^ (out >> np.uint64(30))) * _B
    out = (out ^ (out >> np.uint64(27))) * _C
    return np.unique(out ^ (out >> np.uint64(31)))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, of non-empty sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = small + large - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (small + large - both)


def sketches(docs: DataFrame, doc_id: str, text: str, k: int = SKETCH) -> DataFrame:
    """id, h (hash of the text), n (set size), node (digest of the set; null if empty), sketch (k smallest hashes, 8 bytes each)."""

    def run(batches):
        for batch in slices(batches, 512):
            n, node, sketch = [], [], []
            for t in texts(batch.column(2)):
                s = shingles(t)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary())], ["id", "h", "n", "node", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text)).mapInArrow(run, "id long, h long, n long, node binary, sketch binary")


def retained(classes: DataFrame) -> DataFrame:
    """(value, node): a row for each retained value."""

    def run(batches):
        for batch in slices(batches, 4096):
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(raw), np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), sizes)))],
                ["value", "node"],
            )

    return classes.select("node", "sketch").mapInArrow(run, "value long, node binary")


def _spread(n: float) -> float:
    """What unshared values of n retained ones a pair at the threshold may have: a quarter and four deviations."""
    return 0.25 * n + 4 * (0.1875 * n) ** 0.5


def rare_and_buckets(classes: DataFrame, common: DataFrame, max_broadcast: int) -> DataFrame:
    """node, n, rare (its values outside long lists), keys (buckets; only of classes that need them)."""
    found = common.select("value").limit(max_broadcast + 1).toPandas()["value"].to_numpy(np.int64)  # bounded
    if len(found) <= max_broadcast:
        held = classes.sparkSession.sparkContext.broadcast(np.sort(found))
        rows = classes.select("node", "n", "sketch", F.lit(None).cast("array<long>").alias("long"))
    else:
        held = None
        long = retained(classes).join(common.select("value"), "value").groupBy("node").agg(F.collect_list("value").alias("long"))
        rows = classes.select("node", "n", "sketch").join(long, "node", "left")

    def run(batches):
        for batch in slices(batches, 4096):
            rare, keys = [], []
            for raw, long in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v = np.frombuffer(raw, np.int64)
                among = held.value if held is not None else np.sort(np.array(long or [], np.int64))
                at = np.minimum(np.searchsorted(among, v), max(len(among) - 1, 0))
                is_long = among[at] == v if len(among) else np.zeros(len(v), bool)
                rare.append(v[~is_long].tolist())
                need = (~is_long).sum() <= max(0.25 * len(v), 0.45 * len(v) if len(v) >= 16 else 0.5 * len(v))
                keys.append(bucket_keys(v.view(np.uint64)) if need else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rare, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "rare", "keys"])

    return rows.mapInArrow(run, "node binary, n long, rare array<long>, keys array<long>")


def bucket_keys(values: np.ndarray) -> list[int]:
    """One key for each residue class of the values: its two smallest. Short sketches: every value.

    Sketches that a short one may be linked with (at most 4/3 of its size, so still whole sets) get both kinds.
    """
    out = values.view(np.int64).tolist() if PERCENT * len(values) <= 100 * (2 * BUCKETS - 1) else []
    if len(values) < 2 * BUCKETS:
        return out
    digests = []
    for j in range(BUCKETS):
        own = values[(values >> np.uint64(7)) % np.uint64(BUCKETS) == j][:2]
        if len(own):
            digests.append(xxhash.xxh3_64_intdigest(own.tobytes(), seed=j))
    return out + np.array(digests, np.uint64).view(np.int64).tolist()


def list_pairs(rare: DataFrame, list_limit: int) -> DataFrame:
    """(a, b), a < b, of the short lists, that share as many values as a pair at the threshold must."""
    rows = rare.select(F.explode("rare").alias("value"), F.struct("node", F.col("n").cast("int").alias("n"), F.size("rare").alias("r")).alias("x"))
    lists = rows.groupBy("value").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)

    def run(batches):
        for batch in slices(batches, 2048):
            xs = batch.column(0)
            flat, ends = xs.flatten(), np.diff(xs.offsets.to_numpy())
            n, r, node = (flat.field(i) for i in (1, 2, 0))
            n, r = n.to_numpy(), r.to_numpy()
            left, right, at = [], [], 0
            for size in ends.tolist():
                i, j = np.triu_indices(size, 1)
                left.append(i + at)
                right.append(j + at)
                at += size
            left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            near = 100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right])
            left, right = left[near], right[near]
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(left)), node.take(pa.array(right)), pa.array(np.maximum(r[left], r[right]), pa.int32())],
                ["a", "b", "r"],
            )

    pairs = lists.select("xs").mapInArrow(run, "a binary, b binary, r int")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("o"), F.max("r").alias("r"))
    k = F.lit(float(SKETCH))
    return counted.where(F.col("o") >= F.col("r") - (0.25 * k + 4 * F.sqrt(0.1875 * k))).select("a", "b")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """The pairs whose similarity, estimated from the k smallest of both sketches, may reach the threshold."""
    side = classes.select("node", "sketch", "n")
    rows = pairs.join(side.toDF("a", "sa", "na"), "a").join(side.toDF("b", "sb", "nb"), "b")
    rows = rows.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
    least = percent / 100 - 4.5 * (0.1875 / k) ** 0.5

    def run(batches):
        for batch in slices(batches, 2048):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                twice = np.append(both[1:] == both[:-1], False)
                first = np.flatnonzero(np.append(True, ~twice[:-1]))[:k]  # first places of the k smallest values
                keep.append(twice[first].sum() >= least * len(first))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs that are linked by their full sets. ``bodies``: (node, set), one row for each class."""
    rows = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in slices(batches, 256):
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            mask = pa.array([linked(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def block_links(members: DataFrame, pivots: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): labels of components to join, because a member is linked with a pivot of its bucket by their full sets.

    members: (key, parts, node, label), pivots: (key, parts, node, label). A bucket's members are dealt to
    ``parts`` groups of about BLOCK, each with the bucket's pivots, whose number is bounded.
    """
    kept = ["key", "part", "label", "set"]
    left = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(bodies, "node").select(*kept)
    right = pivots.join(bodies, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part", F.col("part").cast("long")).select(*kept)
    right = right.toDF(*(f"pivot_{c}" for c in kept))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        labels = a.column("label").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in a.column("set").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        wanted = [np.frombuffer(x, np.uint64) for x in b.column("pivot_set").to_pylist()]
        known = np.unique(np.concatenate(wanted))
        every = np.concatenate(sets)
        at = np.minimum(np.searchsorted(known, every), len(known) - 1)
        at[known[at] != every] = len(known)
        x, y = [], []
        trees = Forest()
        for label, own in zip(b.column("pivot_label").to_pylist(), wanted, strict=True):
            mark = np.zeros(len(known) + 1, np.int32)
            mark[np.searchsorted(known, own)] = 1
            both = np.add.reduceat(mark[at], starts)
            for i in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                if labels[i] != label and trees.join(labels[i], label):
                    x.append(labels[i])
                    y.append(label)
        return pa.table({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary())})

    return left.groupBy("key", "part").cogroup(right.groupBy("pivot_key", "pivot_part")).applyInArrow(run, "a binary, b binary")


class Forest:
    """Union-find over hashable nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x
        return x != y


def forest(edges: DataFrame) -> DataFrame:
    """(a, b): each node b of a partition's edges with the smallest node a that these join it to."""

    def run(batches):
        trees = Forest()
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trees.join(x, y)
        nodes = list(trees.up)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([trees.root(x) for x in part], pa.binary()), pa.array(part, pa.binary())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, max_broadcast: int = MAX_BROADCAST_NODES) -> DataFrame:
    """(node, label), label: the smallest node of its component; for nodes with edges.

    Each partition first turns its own edges into stars. Then every label hooks onto the smallest label
    that an edge joins it to, hooks are followed twice, and so on until no edge joins two labels: at most
    half of a component's labels are left by each round.
    """
    stars = written(forest(edges), "stars")
    hint = F.broadcast if stars.limit(max_broadcast + 1).count() <= max_broadcast else lambda df: df
    labels = written(stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "labels")
    while True:
        ends = stars.join(hint(labels.toDF("a", "la")), "a").join(hint(labels.toDF("b", "lb")), "b").where("la <> lb")
        ends = written(ends.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")), "ends")
        if not ends.limit(1).count():
            return labels
        hooks = written(ends.groupBy("label").agg(F.min("to").alias("to")), "hooks")
        twice = hooks.join(hint(hooks.toDF("to", "next")), "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        labels = written(labels.join(hint(twice), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _labelled(df: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(node))
    return df.join(labels.select(F.col("node").alias(node), F.col("label").alias("_l")), node, "left").withColumn(name, F.coalesce("_l", node)).drop("_l")


def class_links(classes: DataFrame, bodies_for: Callable[[DataFrame], DataFrame], list_limit: int = LIST_LIMIT, max_broadcast: int = MAX_BROADCAST_VALUES, percent: int = PERCENT) -> DataFrame:
    """(node, label) of all classes that are linked with another."""
    counts = retained(classes).groupBy("value").agg(F.count("*").alias("c"))
    common = written(counts.where(F.col("c") > list_limit), "long")
    held = written(rare_and_buckets(classes, common, max_broadcast), "rare")
    listed = written(estimated(list_pairs(held, list_limit), classes, percent), "listed")
    members = written(held.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "node"), "members")
    # counts are written before they are joined, so that the join is a broadcast or can split a hot bucket
    sizes = written(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    buckets = members.join(sizes, "key").select("key", F.ceil(F.col("c") / BLOCK).alias("parts"), "node")
    buckets = written(buckets, "buckets")
    any_bucket = buckets.limit(1).count() > 0
    bodies = bodies_for(listed.select(F.col("a").alias("node")).union(listed.select("b")).union(buckets.select("node")).distinct())

    labels, used, turn = None, None, 0
    while True:
        turn += 1
        found = []
        if turn == 1:  # a path through each group: every class with its smallest partner
            found.append(verified(listed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), bodies, percent))
        elif turn == 2:  # all that this did not join
            left = _labelled(_labelled(listed, labels, "a", "la"), labels, "b", "lb")
            found.append(verified(left.where("la <> lb").select("a", "b"), bodies, percent))
        if any_bucket:
            own = _labelled(buckets, labels, "node", "label")
            if turn == 1:
                some = own.groupBy("key", "parts").agg(F.min("node").alias("node")).withColumn("label", F.col("node"))
            else:
                sizes = own.groupBy("key", "label").agg(F.count("*").alias("c"))
                main = sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
                main = written(main, "main")
                rest = own.join(main, "key").where(F.col("label") != F.col("main")).select("key", "parts", "node", "label")
                if used is not None:
                    rest = rest.join(used, ["key", "node"], "left_anti")
                place = F.row_number().over(W.partitionBy("key", "_s").orderBy("node"))
                # dealt anew by key and part: the join's own partitions hold whole buckets
                salted = rest.withColumn("_s", F.pmod(F.xxhash64("node", "key"), F.lit(SALTS))).repartition("key", "_s")
                some = salted.withColumn("_n", place).where(F.col("_n") <= MAX_PIVOTS // SALTS).drop("_n", "_s")
                some = written(some, "pivots")
                if turn > 2 and some.limit(1).count() == 0:
                    break
                mine = some.select("key", "node")
                used = mine if used is None else used.union(mine)
                own = own.join(some.select("key").distinct(), "key", "left_semi")
            found.append(block_links(own, some, bodies, percent))
        fresh = written(found[0] if len(found) == 1 else found[0].union(found[1]), "fresh")
        if labels is not None and not fresh.limit(1).count():
            if not any_bucket:
                break
            continue
        # components so far stand for their links
        links = fresh if labels is None else fresh.union(labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))
        labels = components(links)
        if turn >= 2 and not any_bucket:
            break
    return labels


def bodies_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, doc_id: str, text: str, repeats: bool, max_broadcast: int) -> DataFrame:
    """(node, set), written: the full set of each needed class, sorted, 8 bytes a shingle."""
    wanted = written(classes.join(needed, "node").select(F.col("rep.id").alias("_id"), F.col("rep.h").alias("_h"), "node"), "needed")
    whole = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"))
    found = whole.join(broadcast_within(wanted, max_broadcast), ["_id", "_h"]).select("node", "text")
    found = found.groupBy("node").agg(F.first("text").alias("text")) if repeats else found

    def run(batches):
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())], ["node", "set"])

    return written(found.mapInArrow(run, "node binary, set binary"), "bodies")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", list_limit: int = LIST_LIMIT, max_broadcast: int = MAX_BROADCAST_VALUES, percent: int = PERCENT, with_hash: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept; ``with_hash``: and text_hash, xxhash64 of the text."""
    sets = written(sketches(docs, doc_id, text), "sets")
    named = sets.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    repeats = named.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    classes = written(named.groupBy("node").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.count("*").alias("c")), "classes")
    labels = class_links(
        classes.select("node", "sketch", "n"), lambda needed: bodies_of(docs, classes, needed, doc_id, text, repeats, max_broadcast), list_limit, max_broadcast, percent
    )
    near = classes.select("node", F.col("rep.id").alias("rep")).join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    lowest = near.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = near.join(lowest, "label").select("node", "component_id")
    own = sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("node")).alias("node"), *([F.col("h").alias("text_hash")] if with_hash else []))
    out = join_hot(own, of_class, "node", classes.select("node", "c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *(["text_hash"] if with_hash else [])).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, with all columns: those that hold the smallest id of their component, and what has no id, words or text.

    Rows that repeat an id are judged each by its own text: one stays if its text's component begins with its id.
    """
    judged = near_duplicates(docs, doc_id, text, with_hash=True, **options).where(~F.col("kept"))
    gone = "_gone"
    while gone in docs.columns:
        gone += "_"
    own = F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    return docs.join(judged.select(F.struct("doc_id", "text_hash").alias(gone)).distinct(), own == F.col(gone), "left_anti")
