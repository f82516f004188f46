"""Deduplication by keys. Row order is an explicit column; windows partition by the key and never by a constant."""

from __future__ import annotations

import heapq
import math
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.operators.components import components
from terrano.session import broadcast_within, join_hot, written


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark limits groups to one row before the shuffle, so hot keys stay small."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def completeness(columns: list[str]) -> Column:
    """How many of the columns hold something: not null, blank or zero."""
    return sum((F.when(F.col(c).isNotNull() & ~F.trim(F.col(c).cast("string")).isin("", "0", "0.0"), 1).otherwise(0) for c in columns), F.lit(0))


def most_complete(df: DataFrame, key: str, columns: list[str], order: str, keep_keyless: bool = False) -> DataFrame:
    """The most complete row of each key, the earliest on ties; rows without key are dropped or kept."""
    kept = first_wins(df.where(F.col(key).isNotNull()).withColumn("completeness", completeness(columns)), [key], [F.col("completeness").desc(), F.col(order).asc()])
    if keep_keyless:
        kept = kept.unionByName(df.where(F.col(key).isNull()).withColumn("completeness", completeness(columns)))
    return kept


def cross_owner(df: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """``df`` with first_owner of the key and cross_owner, whether the row's owner is another. Aggregated first, then joined: no window over a hot key."""
    first = df.groupBy(key).agg(F.min_by(owner, order).alias("first_owner"))
    return df.join(first, key).withColumn("cross_owner", F.col(owner) != F.col("first_owner"))


def office_addresses(df: DataFrame, host: str, address: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """(host, address, n, total) of addresses that more than ``share`` of a host's rows have, from ``least`` rows on.

    Rows without address count in the total.
    """
    each = df.groupBy(host, address).agg(F.count("*").alias("n"))
    total = each.groupBy(host).agg(F.sum("n").alias("total"))
    return each.join(total, host).where(F.col(address).isNotNull() & (F.col("total") >= least) & (F.col("n") > share * F.col("total")))


def drop_office_addresses(df: DataFrame, host: str, address: str, **options) -> DataFrame:
    """``df`` with those addresses nulled and office_address telling so."""
    found = office_addresses(df, host, address, **options).select(host, address, F.lit(True).alias("_office"))
    out = df.join(found, [host, address], "left")
    return out.withColumn("office_address", F.coalesce("_office", F.lit(False))).withColumn(address, F.when(~F.col("office_address"), F.col(address))).drop("_office")


def groups(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """keys, n, first_id, last_id of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id")).where("n > 1")


def _unmatched(short: int, long: int, ratio: float) -> tuple[int, int] | None:
    """How many characters of the shorter and of the longer of two names a pair at the ratio may leave unmatched; None if different names can not reach it."""
    free = int((1 - ratio) * (short + long) + 1e-6)
    free -= (free - (long - short)) % 2
    return None if free < max(1, long - short) else ((free - long + short) // 2, (free + long - short) // 2)


#: Variants of both names of a pair up to which they meet on what is left of each without its unmatched characters.
MAX_VARIANTS = 256


def _partners(lengths: list[int], ratio: float) -> dict[int, list[tuple[int, int, int, bool]]]:
    """By length: (length of a name that is as long or longer, unmatched of the shorter and of the longer, whether few variants do)."""
    out = {}
    for short in lengths:
        near = ((long, _unmatched(short, long, ratio)) for long in lengths if short <= long <= short * (2 / ratio - 1) + 1)
        out[short] = [(long, *u, math.comb(short, u[0]) + math.comb(long, u[1]) <= MAX_VARIANTS) for long, u in near if u]
    return out


def _ways(length: int, free: int) -> list[list[int]]:
    """Bounds of a name's pieces: one more than a pair may spoil, and twice as many, of which the rarest that many do. Each unmatched character spoils one at most."""
    if free >= length:
        return [[0, 0]]
    return [[k * length // n for k in range(n + 1)] for n in (free + 1, min(length, 2 * free + 2))]


def _variants(x: str, without: int) -> set[str]:
    return {"".join(v) for v in combinations(x, len(x) - without)}


class _Meeting:
    """Where names of the given lengths are listed as the shorter of a pair, and where they look as the longer."""

    def __init__(self, lengths: list[int], ratio: float):
        self.longer = _partners(sorted(lengths), ratio)
        self.shorter = {n: [] for n in lengths}
        for short, partners in self.longer.items():
            for long, a, b, few in partners:
                self.shorter[long].append((short, a, b, few))
        self.free = {n: max((a + b for _, a, b, few in partners if not few), default=-1) for n, partners in self.longer.items()}

    def variants(self, x: str) -> list[str]:
        return [f"{len(x)}:{long}:{v}" for long, a, _, few in self.longer[len(x)] if few for v in _variants(x, a)]

    def pieces(self, x: str) -> list[list[str]]:
        """The pieces of either way; none if variants do for all partners."""
        if self.free[len(x)] < 0:
            return [[], []]
        ways = [[f"{len(x)}/{w}/{k}/{x[a:b]}" for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] for w, cuts in enumerate(_ways(len(x), self.free[len(x)]))]
        return [*ways, []][:2]

    def looks(self, y: str) -> list[str]:
        """What variants and pieces of any name up to this one's length, that reaches the ratio with it, may be."""
        out = set()
        for short, before, after, few in self.shorter[len(y)]:
            if few:
                out.update(f"{short}:{len(y)}:{v}" for v in _variants(y, after))
                continue
            for w, cuts in enumerate(_ways(short, self.free[short])):
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.update(f"{short}/{w}/{k}/{y[at : at + b - a]}" for at in range(max(0, a - before), min(len(y) - b + a, a + after) + 1))
        return list(out)


#: Names that one part of a list holds; parts of long lists that are broadcast.
PIECE_PART = 1000
MAX_BROADCAST_LISTS = 1_000_000


def fuzzy_pairs(df: DataFrame, id_column: str, name: str, block: Column | None = None, ratio: float = 0.92, part: int = PIECE_PART) -> DataFrame:
    """Pairs of different names (of one block, if given) that reach a Ratcliff-Obershelp ratio, with the first id of each name.

    Equal names count once, so copies make no pairs. A pair at the ratio leaves few characters unmatched. Where these can be left out
    in few ways, both names are listed without them and meet on what is left. Else, of the pieces of the shorter name all but few
    stand whole in the longer near their place; of any one more than that, one does. Each name is listed under few long pieces or under the
    rarest of more short ones, whatever meets fewer names, so a word that a third of all names share lists none that has other pieces;
    lists of more than ``part`` names are split, and who looks there looks into each part. Lists hold numbers of names; a
    pair's names are joined once. Empty and null names make no pairs.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        made = (SequenceMatcher(None, x, y) for x, y in zip(a, b, strict=True))
        return pd.Series([m.ratio() if m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio else 0.0 for m in made])

    rows = df.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.min(id_column).alias(id_column)).select(F.struct(F.col(id_column).alias("id"), F.col(name).alias("name")).alias("x"), (F.lit(0) if block is None else block).alias("_block"))
    rows = written(rows.where(F.col("_block").isNotNull()).withColumn("_n", F.monotonically_increasing_id()), "names")
    meeting = _Meeting([r[0] for r in rows.select(F.length("x.name")).distinct().collect()], ratio)

    @F.pandas_udf("struct<variants: array<string>, few: array<string>, more: array<string>>")
    def own(x: pd.Series) -> pd.DataFrame:
        pieces = x.map(meeting.pieces)
        return pd.DataFrame({"variants": x.map(meeting.variants), "few": pieces.str[0], "more": pieces.str[1]})

    @F.pandas_udf("array<string>")
    def looks(x: pd.Series) -> pd.Series:
        return x.map(meeting.looks)

    spread = rows.repartition(tasks, "_n")
    key = F.xxhash64("_block", "_key").alias("_key")  # names that meet by chance are told apart in the end
    owned = written(spread.select("_n", "_block", own("x.name").alias("_own")).select("_n", "_block", "_own.*"), "owned")
    pieces = owned.select("_n", "_block", F.size("few").alias("_needed"), F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("few").alias("keys")), F.struct(F.lit(1).alias("way"), F.col("more").alias("keys")))).alias("_w"))
    pieces = written(pieces.select("_n", "_block", "_needed", "_w.way", F.explode("_w.keys").alias("_key")).select("_n", "_needed", "way", key), "pieces")
    counts = written(pieces.groupBy("_key").agg(F.count(F.lit(1)).alias("c")), "counts")
    rarest = F.row_number().over(W.partitionBy("_n", "way").orderBy("c", "_key"))
    ways = join_hot(pieces, counts, "_key", counts).withColumn("_place", rarest).where("_place <= _needed").groupBy("_n", "way").agg(F.sum("c").alias("cost"), F.collect_list("_key").alias("keys"))
    best = ways.groupBy("_n").agg(F.min_by("keys", F.struct("cost", "way")).alias("keys"))
    listed = best.select("_n", F.explode("keys").alias("_key")).unionByName(owned.select("_n", "_block", F.explode("variants").alias("_key")).select("_n", key))
    listed = written(listed, "listed")
    parts = written(listed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts")).where("_parts > 1"), "parts")
    long = broadcast_within(parts, MAX_BROADCAST_LISTS)
    dealt = listed.join(long, "_key", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_n"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    looking = spread.select(F.col("_n").alias("_m"), "_block", F.explode(looks("x.name")).alias("_key")).select("_m", key).join(long, "_key", "left")
    looking = looking.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    met = dealt.join(looking, ["_key", "_part"]).where("_n <> _m").select(F.least("_n", "_m").alias("_n"), F.greatest("_n", "_m").alias("_m")).distinct()
    both = met.join(rows, "_n").join(rows.select(F.col("_n").alias("_m"), F.col("x").alias("y"), F.col("_block").alias("_other")), "_m").where((F.col("_block") == F.col("_other")) & (F.col("x.id") != F.col("y.id")))
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).repartition(tasks, "a.id", "b.id")
    pairs = pairs.select(F.col("a.id").alias("id_a"), F.col("a.name").alias("name_a"), F.col("b.id").alias("id_b"), F.col("b.name").alias("name_b")).withColumn("ratio", alike.asNondeterministic()("name_a", "name_b"))
    return pairs.where(F.col("ratio") >= ratio).select("id_a", "id_b", "ratio")


def first_id_most_complete(df: DataFrame, key: str, columns: list[str], order: str, id_column: str = "id") -> DataFrame:
    """The most complete row of each key, the earliest on ties, under the id of the key's first row; rows without key stay as they are."""
    rows = df.withColumn("completeness", completeness(columns))
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    best = rows.where(keyed).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("*"), F.struct("completeness", (-F.col(order)).alias("_o"))).alias("_x"), F.min_by(id_column, order).alias("_id"))
    return best.select("_x.*", "_id").withColumn(id_column, F.col("_id")).drop("_id").unionByName(rows.where(~keyed))


def groups_with_samples(df: DataFrame, keys: list[str], id_column: str, most: int = 20) -> DataFrame:
    """keys, n, samples of keys with more than one row: the smallest ids, ``most`` at most, limited before they are gathered."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(id_column))
    few = df.withColumn("_n", place).where(F.col("_n") <= most).groupBy(*keys).agg(F.sort_array(F.collect_list(id_column)).alias("samples"))
    return counts.join(few, keys)


def largest_groups(df: DataFrame, keys: list[str], id_column: str, n: int = 200) -> DataFrame:
    """keys, n, ids (ordered, comma-joined) of the largest groups of more than one row; ties by key. The report's length is its feature."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(n)
    ids = df.join(F.broadcast(top.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(id_column)), ",").alias("ids"))
    return top.join(ids, keys)


def merged_groups(df: DataFrame, key: str, order: str, gathered: list[str]) -> DataFrame:
    """The first row of each key with n, its rows, and for each gathered column the distinct values of all of them, sorted."""
    sets = [F.sort_array(F.collect_set(c)).alias(f"{c}_all") for c in gathered]
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("*"), order).alias("_x"), F.count("*").alias("n"), *sets).select("_x.*", "n", *(f"{c}_all" for c in gathered))


def changed(df: DataFrame, stored: str, value: Column) -> DataFrame:
    """Rows whose stored value differs from the one it should be, with nuevo."""
    return df.withColumn("nuevo", value).where(~F.col("nuevo").eqNullSafe(F.col(stored)))


def _settled(left: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that certainly stay, rows that are still open): the first for all their keys stay, those that share a key with these go."""
    firsts = left
    for k in keys:
        first = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
        firsts = firsts.join(first, k, "left")
    mine = F.lit(True)
    for k in keys:
        mine = mine & (F.col(k).isNull() | (F.col(order) == F.col(f"_first_{k}")))
    stays = written(firsts.where(mine).select(order, *keys), "stays")
    left = left.join(stays.select(order), order, "left_anti")
    for k in keys:
        left = left.join(stays.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return stays, written(left.select(order, *keys), "left")


def _in_turn(left: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``left`` that stay, each component of rows that share keys read once in order.

    A component's task holds the keys of rows that stayed until their last row has passed, so a chain of any length needs no memory.
    """
    kind = dict(left.dtypes)[order]
    ends = left
    for n, k in enumerate(keys):
        bounds = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_from{n}"), F.max(order).alias(f"_to{n}"))
        ends = ends.join(bounds, k, "left")
    ends = written(ends, "ends")
    links = None
    for n in range(len(keys)):
        more = ends.where(F.col(f"_from{n}") < F.col(order)).select(F.col(order).alias("a"), F.col(f"_from{n}").alias("b"))
        links = more if links is None else links.unionByName(more)
    placed = ends.join(components(links).select(F.col("id").alias(order), "component"), order, "left").withColumn("component", F.coalesce("component", order))
    rows = placed.repartition("component").sortWithinPartitions("component", order)

    def run(batches):
        now, held, ending = None, set(), []  # ending: a heap of (last row, key)
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("component", order, *keys, *(f"_to{n}" for n in range(len(keys))))}
            stay = []
            for i, (component, at) in enumerate(zip(columns["component"], columns[order], strict=True)):
                if component != now:
                    now, held, ending = component, set(), []
                while ending and ending[0][0] < at:
                    held.discard(heapq.heappop(ending)[1:])
                own = [(columns[f"_to{n}"][i], n, columns[k][i]) for n, k in enumerate(keys) if columns[k][i] is not None]
                if not any(o[1:] in held for o in own):
                    stay.append(at)
                    for o in own:
                        held.add(o[1:])
                        heapq.heappush(ending, o)
            yield pa.RecordBatch.from_arrays([pa.array(stay, batch.column(order).type)], [order])

    return rows.mapInArrow(run, f"`{order}` {kind}")


def unseen(df: DataFrame, keys: list[str], order: str, rounds: int = 2) -> DataFrame:
    """Rows in order, each unless one of its keys was on a row kept before it; null keys meet nothing.

    Nearly all rows are decided by a few rounds of set operations (a round settles every key's first row and what shares a
    key with one that stays, so keys that many rows share are gone at once). What is left falls into components of rows
    that share keys; these are independent, and each is read once in order. ``order``: whole numbers without ties.
    """
    left, kept = written(df.select(order, *keys), "left"), []
    for _ in range(rounds):
        stays, left = _settled(left, keys, order)
        kept.append(stays.select(order))
    if left.limit(1).count():
        kept.append(written(_in_turn(left, keys, order), "kept"))
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    return df.join(every, order, "left_semi")
