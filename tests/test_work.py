"""Claims of runs at the same time, sequences in one order, feeds, rarest pieces and expiring keys."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from terrano.operators import boxes, claims, components, dedupe, feeds, ordered
from terrano.plans import work_queries
from terrano.session import scratch_path
from terrano.streaming import rollups

NOW, LATER = "2024-05-01 10:00:00", "2024-05-01 11:00:00"


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture
def log(spark):
    return claims.Claims(spark, scratch_path(spark, "claims"), patience=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i % 3, 9) for i in range(20)] + [(None, 0, 0), (3, 0, 0)], "id long, priority int, attempts int")


def test_interleaved_claims_share_no_row(log, rows):
    """b reads and picks before a commits: its entry comes too late, and it picks again."""
    late = log.propose(log._pick(rows, 6, "b", NOW, ["priority"], 0), 0)
    a = ids(log.claim(rows, 6, "a", NOW, ["priority"]))
    assert a == [0, 3, 6, 9, 12, 15] and not log.commit(late)
    b = ids(log.claim(rows, 6, "b", NOW, ["priority"]))
    assert len(b) == 6 and not set(a) & set(b) and ids(log.claim(rows, 100, "c", NOW, ["priority"])) == sorted(set(range(20)) - set(a) - set(b))
    assert ids(log.claim(rows, 5, "d", NOW, ["priority"])) == [] and log.version() == 3


def test_claims_of_threads_share_no_row(log, rows):
    got = {}
    work = [threading.Thread(target=lambda o=o: got.update({o: ids(log.claim(rows, 5, o, NOW, ["priority"]))})) for o in "abc"]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert sorted(len(g) for g in got.values()) == [5, 5, 5] and len({i for g in got.values() for i in g}) == 15


def test_crashed_claims_go_back(spark, log, rows):
    a = ids(log.claim(rows, 4, "a", NOW, ["priority"]))
    log.propose(log._pick(rows, 4, "dead", NOW, ["priority"], 1), 1)  # died before its version: holds nothing
    assert log.reclaim(NOW) == 0 and log.finish(rows.where(f"id = {a[0]}"), "b", NOW) == 0
    assert log.finish(rows.where(f"id = {a[0]}"), "a", NOW) == 1
    assert log.reclaim(LATER) == 3 and log.reclaim(LATER) == 0
    before = sorted(map(tuple, log.states().collect()))
    assert log.compact() == log.version() and log.compact() == log.version() and sorted(map(tuple, log.states().collect())) == before
    again = {r["id"]: (r["attempts"], r["owner"]) for r in log.claim(rows, 3, "b", LATER, ["priority"]).collect()}
    assert again == {i: (1, "b") for i in a[1:]}
    for _ in range(4):
        log.reclaim("2030-01-01 00:00:00")
        log.claim(rows, 3, "b", LATER, ["priority"])
    assert log.reclaim("2031-01-01 00:00:00", most=5) == 0  # tried often enough


def test_a_version_that_nobody_filled_is_void(log, rows):
    log._create("versions/000000000001", "")
    got = ids(log.claim(rows, 2, "a", NOW, ["priority"]))
    assert len(got) == 2 and log.version() == 2 and log._exists("void/000000000001")
    assert log._entry(1) is None and ids(log.states()) == got


def test_batches_until_nothing_is_left(spark, rows):
    """A run that is stopped after its work but before its entry handles that slice again; the whole equals a single batch."""
    out, log, seen = scratch_path(spark, "out"), claims.Claims(spark, scratch_path(spark, "claims")), []

    def work(df, batch):
        df.withColumn("twice", F.col("id") * 2).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        claims.until_empty(log, rows, 7, "a", NOW, ["priority"], work)
    assert claims.until_empty(log, rows, 7, "a", NOW, ["priority"], work) == 2 and len(seen) == 4 and seen[1] == seen[2]
    done = spark.read.parquet(out)
    assert sorted((r["id"], r["twice"]) for r in done.collect()) == [(i, 2 * i) for i in range(20)]
    assert claims.until_empty(log, rows, 7, "a", NOW, ["priority"], work) == 0


def test_components_of_paths_stars_and_rings(spark):
    pick = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5)]
    edges += [(3000 + pick.randrange(200), 3000 + pick.randrange(200)) for _ in range(150)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        up[rb] = ra
    pick.shuffle(edges)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sequential(rows):
    webs, used, want = set(), set(), []
    for i, a, b in sorted(rows):
        if (a is None or a not in webs) and (b is None or b not in used):
            want.append(i)
            webs |= {a} - {None}
            used |= {b} - {None}
    return want


def test_long_chains_of_keys_take_few_jobs(spark):
    """Ten thousand rows of which each shares a key with the next, the first decided last by rounds alone; and a key that thousands share."""
    chain = [(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(10_000)]
    hot = [(20_000 + i, "hot", f"h{i}") for i in range(4000)]
    df = spark.createDataFrame(chain + hot + [(50_000, None, None)], "i long, a string, b string")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    got = sorted(r["i"] for r in dedupe.unseen(df, ["a", "b"], "i").collect())
    assert got == sequential(chain + hot + [(50_000, None, None)])
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 600


def test_greedy_selection_equals_a_pass(spark):
    pick = random.Random(8)
    rows = [(i, pick.choice([None, "x", *map(str, range(12))]), pick.random() < 0.2) for i in range(120)]
    taken = [(3,), (5,), (None,)]
    df, held = spark.createDataFrame(rows, "pos long, agency string, bad boolean"), spark.createDataFrame(taken, "id long")
    for limit in (0, -1, 1, 4, 10, 500):
        want, made, seen = {}, 0, set()
        for i, a, bad in rows:
            if limit > 0 and made >= limit:
                want[i] = "not_reached"
            elif bad:
                want[i] = "bad"
            elif a is None or not a.isdigit():
                want[i] = "inmobiliaria_id_invalido"
            elif int(a) in (3, 5):
                want[i] = "ya_tiene_pending"
            elif a in seen:
                want[i] = "duplicado_en_lote"
            else:
                want[i] = "create"
                seen.add(a)
                made += 1
        got = ordered.select_greedily(df, F.when(F.col("bad"), "bad"), "agency", held, limit, "pos")
        assert {r["pos"]: r["outcome"] for r in got.collect()} == want and set(got.columns) == {*df.columns, "outcome"}
    assert ordered.select_greedily(df.limit(0), F.lit(None).cast("string"), "agency", held, 3, "pos").count() == 0


def plain_feed(text, depth=4):
    """(depth, array) of a payload's items, by a walk over Python's own lists and dicts."""
    try:
        level = [("", json.loads(text))]
    except (TypeError, ValueError):
        return None
    for d in range(depth + 1):
        good = [(k, x) for k, x in level if isinstance(x, list) and x and isinstance(x[0], dict) and (set(x[0]) & set(feeds.ITEM_KEYS) or k in feeds.LIST_KEYS)]
        if good:
            rank = lambda kx: (feeds.LIST_KEYS.index(kx[0]) if kx[0] in feeds.LIST_KEYS else len(feeds.LIST_KEYS), kx[0])
            return d, min(good, key=rank)[1]
        level = [y for _, x in level for y in (x.items() if isinstance(x, dict) else [("", v) for v in x] if isinstance(x, list) else [])]
    return None


def test_item_arrays_equal_a_walk(spark, sf):
    rows = [(r["id"], r["payload"]) for r in work_queries.payloads(spark, sf).where("id < 80").collect()]
    rows += [(1000, None), (1001, "[]"), (1002, '[[{"price": 1}]]'), (1003, '{"zz": [{"area": 1}], "data": [{"q": 1}], "aa": [{"area": 2}]}'), (1004, '{"x": [{"q": [{"price": 2}]}]}'), (1005, '"text"'), (1006, '{"price": 3}')]
    got = {r["id"]: (r["depth"], json.loads(r["items"])) for r in feeds.item_arrays(spark.createDataFrame(rows, "id long, payload string"), "payload", "id").collect()}
    assert got == {i: found for i, p in rows if (found := plain_feed(p))}


def test_fuzzy_pairs_with_common_words_equal_brute_force(spark):
    """A word that most names share, edits at the beginning, and lists split into parts of a few names."""
    from difflib import SequenceMatcher

    pick = random.Random(6)
    word = lambda n: "".join(pick.choice("abcdefghijklmnop") for _ in range(n))
    names = [f"inmobiliaria {word(9)}" for _ in range(60)] + [word(pick.randrange(1, 30)) for _ in range(30)] + ["", None]
    for n in names[:70]:
        at = pick.randrange(len(n))
        names.append(pick.choice([n[:at] + n[at + 1 :], n[:at] + "z" + n[at:], "z" + n[1:], n]))
    rows = list(enumerate(names))
    first = {}
    for i, n in rows:
        if n:
            first.setdefault(n, i)
    by_id = sorted((i, n) for n, i in first.items())
    want = {(i, j) for x, (i, a) in enumerate(by_id) for j, b in by_id[x + 1 :] if SequenceMatcher(None, a, b).ratio() >= 0.92}
    df = spark.createDataFrame(rows, "id long, name string")
    for part in (1000, 3):
        got = {(r["id_a"], r["id_b"]) for r in dedupe.fuzzy_pairs(df, "id", "name", part=part).collect()}
        assert got == want and len(want) > 20


def test_seen_keys_expire(spark):
    """Two runs from one checkpoint do not see a key twice within its time; a later one does."""
    folder, state, out = (scratch_path(spark, x) for x in ("in", "state", "out"))
    runs = [[("a", 0), ("b", 0)], [("a", 1), ("c", 1)], [("d", 9)], [("a", 10), ("d", 10)]]
    for k, rows in enumerate(runs):
        df = spark.createDataFrame([(key, k, f"2024-01-01 {h:02d}:00:00") for key, h in rows], "key string, run int, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.write.mode("append").parquet(folder)
        rollups.for_each_new(spark.readStream.schema(df.schema).parquet(folder), ["key"], "2 hours", "at", lambda new, b: new.write.mode("overwrite").parquet(f"{out}/batch={b}"), state).awaitTermination()
    assert sorted((r["key"], r["run"]) for r in spark.read.schema("key string, run int").parquet(f"{out}/batch=*").collect()) == [("a", 0), ("a", 3), ("b", 0), ("c", 1), ("d", 2)]


def test_points_within_boxes_equal_brute_force(spark):
    """Boxes from points to the whole world, crossed and missing bounds, points on edges; broadcast and shuffled."""
    pick = random.Random(4)
    at = lambda: round(pick.uniform(-90, 90) * 64) / 64  # noqa: E731  often on the edges of cells
    made = []
    for i in range(120):
        y, x, size = at(), at(), pick.choice([0, 1 / 64, 0.5, 3, 40, 200])
        made.append((i, y, y + size, x, x + pick.choice([0, size, size / 3])))
    made += [(500, -90.0, 90.0, -180.0, 180.0), (501, 5.0, 1.0, 0.0, 1.0), (502, None, 1.0, 0.0, 1.0)]
    points = [(i, at(), at()) for i in range(300)] + [(i + 1000, b[1], b[4]) for i, b in enumerate(made[:100])] + [(2000, None, 1.0)]
    want = sorted((p[0], b[0]) for p in points for b in made if p[1] is not None and b[1] is not None and b[1] <= p[1] <= b[2] and b[3] <= p[2] <= b[4])
    frames = spark.createDataFrame(points, "id long, latitud double, longitud double"), spark.createDataFrame(made, "box long, south double, north double, west double, east double")
    for bound in (1000, 0):
        assert sorted((r["id"], r["box"]) for r in boxes.within_boxes(*frames, max_broadcast=bound).collect()) == want
    assert boxes.within_boxes(frames[0], frames[1].limit(0)).count() == 0 and len(want) > 300


def test_places_and_bounds_meet_once(spark):
    """Copies of boxes and of points are counted without a pair for each: 3,000 of both, of one place and one bounds, beside others."""
    met = []
    pairs = boxes.within_boxes
    rows = spark.range(3000).select(F.col("id").alias("box"), *(F.lit(x).alias(c) for c, x in (("south", 0.0), ("north", 1.0), ("west", 0.0), ("east", 1.0))))
    rows = rows.unionByName(spark.createDataFrame([(5000, 0.5, 2.0, 0.5, 2.0), (5001, None, 1.0, 0.0, 1.0), (5002, 0.5, 2.0, 0.5, 2.0)], "box long, south double, north double, west double, east double"))
    points = spark.range(3000).select("id", F.lit(0.25).alias("latitud"), F.lit(0.25).alias("longitud"))
    points = points.unionByName(spark.createDataFrame([(4000, 0.75, 1.0), (4001, 1.5, 1.5), (4002, 9.0, 9.0), (4003, None, 1.0)], "id long, latitud double, longitud double"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(boxes, "within_boxes", lambda *a, **k: met.append(pairs(*a, **k)) or met[-1])
        got = {r["id"]: (r["n"], r["first_box"], r["last_box"]) for r in boxes.count_boxes(points, rows).collect()}
    assert met[0].count() == 4
    assert got == {i: (3000, 0, 2999) for i in range(3000)} | {4000: (3002, 0, 5002), 4001: (2, 5000, 5002)}


@pytest.mark.parametrize("ratio", [0.92, 0.8, 0.6])
def test_fuzzy_pairs_of_digests_and_numbered_names_equal_brute_force(spark, ratio):
    """Names that meet by variants, by pieces and, where a pair may leave more unmatched than a short name has, all of them; blocks keep apart."""
    from difflib import SequenceMatcher

    pick = random.Random(11)
    digest = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    names = [digest(n) for n in (32, 32, 32, 33, 40, 40)] + [f"{w}{k}" for w in ("largering", "hotbolt") for k in pick.sample(range(10000, 10400), 25)] + [digest(pick.randrange(1, 6)) for _ in range(12)]
    for n in list(names):
        edited = n
        for _ in range(pick.randrange(1, 4)):
            at = pick.randrange(len(edited) or 1)
            edited = pick.choice([edited[:at] + edited[at + 1 :], edited[:at] + "z" + edited[at:], edited[:at] + "y" + edited[at + 1 :]])
        names.append(edited)
    rows = [(i, n) for i, n in enumerate(dict.fromkeys(n for n in names if n))]
    want = {(i, j): SequenceMatcher(None, a, b).ratio() for i, a in rows for j, b in rows if i < j and i % 2 == j % 2 and SequenceMatcher(None, a, b).ratio() >= ratio}
    got = dedupe.fuzzy_pairs(spark.createDataFrame(rows, "id long, name string"), "id", "name", F.col("id") % 2, ratio).collect()
    assert len(want) > 10 and {(r["id_a"], r["id_b"]): r["ratio"] for r in got} == want and len(got) == len(want)


def test_names_are_listed_and_sought_in_few_places():
    """A digest looks into a hundred lists, not seven hundred, and a numbered name meets only what is left of it without the unmatched characters."""
    digest, numbered = "0123456789abcdef" * 2, "largering12345"
    meeting = dedupe._Meeting([13, 14, 32, 33], 0.92)
    assert len(meeting.looks(digest)) <= 100 and [len(p) for p in meeting.pieces(digest)] == [6, 12]
    assert len(meeting.looks(numbered)) <= 28 and meeting.pieces(numbered) == [[], []]
    assert set(meeting.variants("largering12345")) & set(meeting.looks("largering12385")) and not set(meeting.variants("largering12345")) & set(meeting.looks("largering12486"))
