"""Conversation structure repair by divide and conquer in linear space.

A conversation's role initials shall read ``(s?(ua)+)?``. Its reader has four states: nothing read, after the
system turn, after a user, after an assistant. Each row is kept, given the role user or assistant, or deleted,
and turns without text may be inserted; of the cheapest edits the one whose initials (D, I, K, R in order) come
first is taken. A row is thus a 4 x 4 table of the cheapest way from state to state, and tables of adjacent
stretches combine. Ties need no strings: the edits of a stretch that begin in one state and end behind its last
row are never beginnings of each other, so four *ranks* beside the four costs order them, and ranks combine too.

``crossings`` finds the states at all borders of a run of tables: forward costs and ranks up to the middle and
backward costs from the end meet there, the audit-least of the cheapest crossings is fixed, and both halves
follow with it (Hirschberg's scheme), so beside the answer only two vectors of four are held.

The same routine works at every level, so no conversation needs to fit a task: rows are sorted by ranges, each
task cuts its stretch of a conversation into blocks of bounded size and gives every block's table; tables are
combined ``FAN`` at a time into a tree as high as the longest conversation needs, states are handed down it
again, and each block finds its own edits between its two states. Only the digest of a whole conversation's
text is sequential by nature; it streams through one task in order, a block at a time.

Defined cases: a null role or text is one space, and so counts as blank or as a role that cannot stay; an empty
role cannot stay either; rows without turn come first; rows of one turn follow by role and text; equal rows of
one turn stand side by side; rows without a conversation id form one conversation; a conversation without rows
has no edits; an empty table gives an empty table; other columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.llm.arrow_map import slices
from terrano.session import broadcast_within, join_hot, written

#: Rows and characters of a block, and blocks or nodes that one node of the tree combines.
BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 20
FAN = 256
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NO_WAY = 1 << 50
#: Rows of a block up to which a worker remembers what it found for the same kinds of rows.
SHORT = 16
#: Rows of the plan up to which it is broadcast (about 40 MB).
MAX_BROADCAST_PLAN = 1_000_000
#: Which state a turn of this initial leads to.
READ = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE_OF = {"u": "user", "a": "assistant"}
#: Extra cost of ending in each state, and the inserted turns it stands for.
ENDING = (0, 2 * INSERT, INSERT, 0)
_WHITE = r"[^\x20\x09-\x0D]"


def inserted() -> dict[tuple[int, int], str]:
    """(from, to) -> initials of the turns inserted on the shortest way between two states; two suffice, as states then repeat."""
    ways = {(s, s): "" for s in range(STATES)}
    for s in range(STATES):
        at, made = s, ""
        for _ in range(2):
            role = next(r for r in ("u", "a") if (at, r) in READ)
            at, made = READ[at, role], made + role
            ways.setdefault((s, at), made)
    return ways


INSERTED = inserted()


def row_ways(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str, str]]:
    """(from, to) -> (cost, edits, new role's initial or '') of one row with the turns inserted before it."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for (s, mid), made in INSERTED.items():
        before, cost = "I" * len(made), INSERT * len(made)
        ends = [(mid, cost + DELETE, before + "D", "")]
        if fault not in ("blank", "duplicate"):
            cost += TRUNCATED if fault == "truncated" else 0
            if (mid, initial) in READ:
                ends.append((READ[mid, initial], cost + KEEP, before + "K", ""))
            ends += [(READ[mid, r], cost + REROLE, before + "R", r) for r in ROLE_OF if (mid, r) in READ]
        for to, *way in ends:
            best[s, to] = min(best.get((s, to), (NO_WAY, "", "")), tuple(way))
    return best


#: (role's initial or '', fault or '') -> ways of the row.
WAYS = {(i, f): row_ways(i, f) for i, f in product(("s", "u", "a", ""), ("", "truncated", "blank"))}


def table(ways: dict[tuple[int, int], tuple[int, str, str]]) -> list[list[tuple[int, int]]]:
    """[from][to] = (cost, rank among the ways from that state) of a row."""
    out = []
    for s in range(STATES):
        order = sorted(edits for (a, _), (_, edits, _) in ways.items() if a == s)
        out.append([(w[0], order.index(w[1])) if (w := ways.get((s, t))) else (NO_WAY, STATES) for t in range(STATES)])
    return out


TABLES = {k: table(w) for k, w in WAYS.items()}


def onward(vector: list[tuple[int, int]], step: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Costs and ranks behind a table, from those before it."""
    best = []
    for t in range(STATES):
        best.append(min((vector[s][0] + step[s][t][0], vector[s][1], step[s][t][1]) for s in range(STATES)))
    order = sorted({(r, q) for c, r, q in best if c < NO_WAY})
    return [(c, order.index((r, q))) if c < NO_WAY else (NO_WAY, STATES) for c, r, q in best]


def start(state: int) -> list[tuple[int, int]]:
    return [(0, 0) if s == state else (NO_WAY, STATES) for s in range(STATES)]


def combined(tables: list) -> list[list[tuple[int, int]]]:
    """The table of a run of tables."""
    out = []
    for s in range(STATES):
        vector = start(s)
        for step in tables:
            vector = onward(vector, step)
        out.append(vector)
    return out


def crossings(tables: list, state: int, ending: tuple[int, ...]) -> list[int]:
    """The states behind each table on the audit-least of the cheapest ways from ``state``; ``ending``: extra cost of the last state."""
    out = [0] * len(tables)
    open_runs = [(0, len(tables), state, ending)]
    while open_runs:
        low, high, first, last = open_runs.pop()
        if low == high:
            continue
        middle = (low + high + 1) // 2
        ahead = start(first)
        for i in range(low, middle):
            ahead = onward(ahead, tables[i])
        behind = list(last)
        for i in range(high - 1, middle - 1, -1):
            step = tables[i]
            behind = [min(step[s][t][0] + behind[t] for t in range(STATES)) for s in range(STATES)]
        cost, _, at = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in range(STATES))
        out[middle - 1] = at
        if middle - low > 1:
            open_runs.append((low, middle - 1, first, backward(tables[middle - 1], at)))
        open_runs.append((middle, high, at, last))
    return out


def backward(step: list[list[tuple[int, int]]], to: int) -> tuple[int, ...]:
    """Extra cost of the state before a table whose end is fixed."""
    return tuple(step[s][to][0] for s in range(STATES))


def lines(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, c: the distinct rows and how often they occur, nulls of role and text as one space."""
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    return plain.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("c"))


def with_faults(distinct: DataFrame) -> DataFrame:
    """``lines`` with ``fault`` of the first copy: blank, duplicate, truncated or ''. Copies behind it are duplicates, or blank as it is."""
    spark = distinct.sparkSession
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.col("role"), F.lit("\x00"), F.col("text")), 256)
    rows = written(distinct.withColumn("_said", F.when(F.regexp_like("text", F.lit(_WHITE)), said)), "lines")
    lowest = F.min(F.coalesce(F.col("turn"), F.lit(-(1 << 63)).cast("long")))
    groups = rows.where(F.col("_said").isNotNull()).groupBy("_said").agg(lowest.alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = written(groups, "said")  # texts said in one turn only need no second look
    joined = join_hot(rows, groups.select("_said", "_first"), "_said", groups)
    again = F.coalesce(F.col("turn"), F.lit(-(1 << 63)).cast("long")) > F.col("_first")
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("_said").isNull(), "blank").when(F.coalesce(again, F.lit(False)), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "c", fault.alias("fault"))


BLOCK = "conv_id long, part int, block long, turns array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<string>"
TABLE = "array<array<struct<cost: long, rank: int>>>"
SUMS = "rows long, distinct_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"


def blocks(faulty: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block (BLOCK), written: stretches of one conversation in order, ``part`` and ``block`` giving theirs."""
    spark = faulty.sparkSession
    kind = dict(faulty.dtypes)["conv_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_rows = faulty.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ["turn", "role", "text", "c", "fault"]

    def run(batches):
        part, block, held, chars, now = TaskContext.get().partitionId(), 0, [], 0, None
        types = None

        def made():
            columns = [[now], [part], [block], *([list(c)] for c in zip(*held, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "part", "block", "turns", "roles", "texts", "copies", "faults"])

        for batch in slices(batches, 512):
            texts_type = pa.list_(pa.string())
            types = [batch.column("conv_id").type, pa.int32(), pa.int64(), pa.list_(pa.int64()), texts_type, texts_type, pa.list_(pa.int64()), texts_type]
            for conv, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True):
                if held and (conv != now or len(held) == block_rows or chars + len(row[2]) > BLOCK_CHARS):
                    yield made()
                    block, held, chars = block + 1, [], 0
                now = conv
                held.append(row)
                chars += len(row[2])
        if held:
            yield made()

    return written(sorted_rows.select("conv_id", *names).mapInArrow(run, BLOCK.replace("conv_id long", f"conv_id {kind}")), "blocks")


def _kinds(roles: list[str], faults: list[str]) -> tuple:
    return tuple((r[:1] if r[:1] in ("s", "u", "a") else "", "blank" if f == "duplicate" else f) for r, f in zip(roles, faults, strict=True))


def block_table(kinds: tuple) -> list:
    return combined([TABLES[k] for k in kinds])


def block_edits(kinds: tuple, first: int, last: int) -> tuple[tuple[int, str, str], ...]:
    """(cost, edits, new role's initial) of each row on the way from state to state."""
    fixed = tuple(0 if t == last else NO_WAY for t in range(STATES))
    states = [first, *crossings([TABLES[k] for k in kinds], first, fixed)]
    return tuple(WAYS[k][s, t] for k, s, t in zip(kinds, states, states[1:], strict=False))


@lru_cache(1 << 15)
def _short_table(kinds: tuple) -> list:
    return block_table(kinds)


@lru_cache(1 << 15)
def _short_edits(kinds: tuple, first: int, last: int) -> tuple[tuple[int, str, str], ...]:
    return block_edits(kinds, first, last)


def _as_rows(made: list) -> list:
    return [[{"cost": c, "rank": r} for c, r in line] for line in made]


def _as_tuples(made: list) -> list:
    return [[(x["cost"], x["rank"]) for x in line] for line in made]


def summaries(made: DataFrame) -> DataFrame:
    """conv_id, part, block, table and SUMS of every block. Copies behind a first one are part of no table: they are deleted in any state."""
    schema = made.schema

    def run(batches):
        for batch in slices(batches, 64):
            out = {n: [] for n in ["table", *(x.split()[0] for x in SUMS.split(", "))]}
            for turns, roles, copies, faults in zip(*(batch.column(n).to_pylist() for n in ("turns", "roles", "copies", "faults")), strict=True):
                initials = [r[:1] for r in roles]
                known = [t for t in turns if t is not None]
                kinds = _kinds(roles, faults)
                out["table"].append(_as_rows((_short_table if len(kinds) <= SHORT else block_table)(kinds)))
                out["rows"].append(sum(copies))
                out["distinct_turns"].append(len(set(known)))
                out["first_turn"].append(known[0] if known else None)
                out["last_turn"].append(known[-1] if known else None)
                blank = sum(c for c, f in zip(copies, faults, strict=True) if f == "blank")
                out["blank"].append(blank)
                out["duplicate"].append(sum(c if f == "duplicate" else 0 if f == "blank" else c - 1 for c, f in zip(copies, faults, strict=True)))
                out["truncated"].append(sum(f == "truncated" for f in faults))
                twice = sum(c - 1 for c in copies)
                out["illegal"].append(twice + sum(not _legal(a, b) for a, b in zip(initials, initials[1:])))
                out["first_initial"].append(initials[0])
                out["last_initial"].append(initials[-1])
            node = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("rank", pa.int32())])))
            types = [node, *(pa.string() if n.endswith("initial") else pa.int64() for n in list(out)[1:])]
            columns = [batch.column(n) for n in ("conv_id", "part", "block")] + [pa.array(c, t) for c, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "block", *out])

    kind = schema["conv_id"].dataType.simpleString()
    return made.mapInArrow(run, f"conv_id {kind}, part int, block long, table {TABLE}, {SUMS}")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _node(children: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: (conv_id, node) -> the children in order."""
    return children.groupBy("conv_id", F.floor(F.col("at") / fan).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "table"))).alias("children"))


def placed(sums: DataFrame) -> DataFrame:
    """``summaries`` with ``at``, the block's place in its conversation, and ``blocks``, how many that has."""
    per_part = sums.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("low"))
    of = W.partitionBy("conv_id")  # at most one row a range partition
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = per_part.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), (before - F.col("low")).alias("_base"), F.sum("n").over(of).alias("blocks"))
    return sums.join(bases, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).withColumn("at", F.col("_base") + F.col("block")).drop("_c", "_p", "_base")


def planned(sums: DataFrame, fan: int = FAN) -> DataFrame:
    """part, block, start, end: the state before and behind every block of ``placed`` summaries.

    Levels are written; each has a ``fan``-th of the rows of the one below, and there are as many as the longest conversation needs.
    """
    kind = sums.schema["conv_id"].dataType.simpleString()
    levels = [sums.select("conv_id", "part", "block", "at", "table")]
    nodes = []

    def up(batches):
        for batch in slices(batches, 16):
            made = [_as_rows(combined([_as_tuples(x["table"]) for x in kids])) for kids in batch.column("children").to_pylist()]
            node = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("rank", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("node"), pa.array(made, node)], ["conv_id", "at", "table"])

    while levels[-1].where("at > 0").limit(1).count():
        nodes.append(written(_node(levels[-1], fan), "nodes"))
        levels.append(written(nodes[-1].mapInArrow(up, f"conv_id {kind}, at long, table {TABLE}"), "level"))

    def top(batches):
        for batch in slices(batches, 256):
            got = [crossings([_as_tuples(t)], 0, ENDING)[0] for t in batch.column("table").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array([0] * len(got), pa.int32()), pa.array(got, pa.int32())], ["conv_id", "at", "start", "end"])

    def down(batches):
        for batch in slices(batches, 16):
            conv, at, first, last = [], [], [], []
            for c, kids, s, e in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "children", "start", "end")), strict=True):
                fixed = tuple(0 if t == e else NO_WAY for t in range(STATES))
                got = crossings([_as_tuples(k["table"]) for k in kids], s, fixed)
                conv += [c] * len(kids)
                at += [k["at"] for k in kids]
                first += [s, *got[:-1]]
                last += got
            columns = [pa.array(conv, batch.column("conv_id").type), pa.array(at, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "start", "end"])

    states = levels[-1].select("conv_id", "at", "table").mapInArrow(top, f"conv_id {kind}, at long, start int, end int")
    for level in reversed(nodes):
        states = written(states, "states").alias("s")
        both = level.alias("n").join(states, F.col("n.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("n.node") == F.col("s.at")))
        states = both.select("n.conv_id", "n.children", "s.start", "s.end").mapInArrow(down, f"conv_id {kind}, at long, start int, end int")
    base, states = levels[0].select("conv_id", "part", "block", "at").alias("b"), states.alias("s")
    return base.join(states, F.col("b.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("b.at") == F.col("s.at"))).select("b.part", "b.block", "s.start", "s.end")


def edited(made: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, at, blocks, cost, audit, roles, texts: each block's edits in order and the turns that they leave."""
    kind = made.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 64):
            out = {n: [] for n in ("cost", "audit", "roles", "texts")}
            names = ("roles", "texts", "copies", "faults", "start", "end", "at", "blocks")
            for roles, said, copies, faults, first, last, at, blocks in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                kinds = _kinds(roles, faults)
                edits = (_short_edits if len(kinds) <= SHORT else block_edits)(kinds, first, last)
                total, audit, new_roles, new_texts, state = 0, [], [], [], first

                def turn(initial: str, role: str, text: str) -> None:
                    nonlocal state
                    state = READ[state, initial]
                    new_roles.append(role)
                    new_texts.append(text)

                def insert(n: int) -> None:
                    for _ in range(n):
                        initial = next(r for r in ROLE_OF if (state, r) in READ)
                        turn(initial, ROLE_OF[initial], "")

                for (cost, way, new), role, text, c in zip(edits, roles, said, copies, strict=True):
                    insert(len(way) - 1)
                    if way[-1] == "K":
                        turn(role[0], role, text)
                    elif way[-1] == "R":
                        turn(new, ROLE_OF[new], text)
                    total += cost + DELETE * (c - 1)
                    audit.append(way + "D" * (c - 1))
                if at == blocks - 1:
                    total += ENDING[state]
                    audit.append("I" * (ENDING[state] // INSERT))
                    insert(ENDING[state] // INSERT)
                for name, value in zip(out, (total, "".join(audit), new_roles, new_texts), strict=True):
                    out[name].append(value)
            strings = pa.list_(pa.string())
            columns = [batch.column(n) for n in ("conv_id", "at", "blocks")] + [pa.array(c, t) for c, t in zip(out.values(), (pa.int64(), pa.string(), strings, strings), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "blocks", *out])

    joined = made.join(plan, ["part", "block"]).select("conv_id", "at", "blocks", "start", "end", "roles", "texts", "copies", "faults")
    return joined.mapInArrow(run, f"conv_id {kind}, at long, blocks long, cost long, audit string, roles array<string>, texts array<string>")


def counted(sums: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal of every conversation, from ``placed`` summaries."""
    ahead = sums.select(F.col("conv_id").alias("_c"), (F.col("at") + 1).alias("_at"), F.col("last_turn").alias("_turn"), F.col("last_initial").alias("_initial"))
    both = sums.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_at")), "left")
    split = F.coalesce((F.col("first_turn") == F.col("_turn")).cast("long"), F.lit(0))
    illegal = F.coalesce((~F.concat("_initial", "first_initial").isin("su", "ua", "au")).cast("long"), F.lit(0))
    gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("distinct_turns") - split)
    return both.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + illegal).alias("illegal"))


def prepared(rows: DataFrame, block_rows: int, fan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, their placed summaries, and the plan."""
    made = blocks(with_faults(lines(rows)), block_rows)
    sums = written(placed(written(summaries(made), "sums")), "placed")
    plan = written(planned(sums, fan).join(sums.select("part", "block", "at", "blocks"), ["part", "block"]), "plan")
    return made, sums, plan


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """conv_id, at, place, role, text: the repaired turns; ``at`` and ``place`` give their order in the conversation."""
    made, _, plan = prepared(rows, block_rows, fan)
    out = edited(made, broadcast_within(plan, MAX_BROADCAST_PLAN))
    return out.select("conv_id", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select("conv_id", "at", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _text(roles: str, texts: str) -> Column:
    return F.array_join(F.transform(F.arrays_zip(roles, texts), lambda t: F.concat(t[roles], F.lit(":"), t[texts])), "\n")


def digests(rows: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows``.

    Conversations of one block are digested where they stand; longer ones are dealt by conversation and streamed in order.
    """
    made, sums, plan = prepared(rows, block_rows, fan)
    kind = made.schema["conv_id"].dataType.simpleString()
    short = edited(made, broadcast_within(plan.where("blocks = 1"), MAX_BROADCAST_PLAN))
    short = short.select("conv_id", "cost", "audit", F.sha2(_text("roles", "texts"), 256).alias("repaired_sha256"))
    long = edited(made, broadcast_within(plan.where("blocks > 1"), MAX_BROADCAST_PLAN))
    long = long.select("conv_id", "at", "blocks", "cost", "audit", _text("roles", "texts").alias("text"), F.size("roles").alias("n"))

    def run(batches):
        for batch in slices(batches, 8):
            names = ("conv_id", "at", "blocks", "cost", "audit", "text", "n")
            done = []
            for conv, at, blocks_of, cost, audit, text, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if at == 0:
                    digest, begun, total, audits = hashlib.sha256(), False, 0, []
                if n:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
                total += cost
                audits.append(audit)
                if at == blocks_of - 1:
                    done.append((conv, total, "".join(audits), digest.hexdigest()))
            types = (batch.column("conv_id").type, pa.int64(), pa.string(), pa.string())
            columns = list(zip(*done, strict=True)) if done else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "cost", "audit", "repaired_sha256"])

    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, f"conv_id {kind}, cost long, audit string, repaired_sha256 string")
    found = short.unionByName(long).withColumnRenamed("conv_id", "_c")
    counts = counted(sums).withColumnRenamed("conv_id", "_d")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(counts, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conversation rows with faults put in by the checksum of ``conv_id:turn``, for trying ``repair``; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    plain = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_n")).drop("_n")
