"""The pipeline, stage by stage, against plain Python over the same rows."""

import corpus_pipeline
from terrano.llm import decontaminate, minhash, quality
from terrano.llm.arrow_map import plain_words


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    (_, low), (_, near), (_, bench), (_, private), (_, pack) = corpus_pipeline.STAGES

    one = low(spark, docs, sf)
    machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = text(one)
    assert one.columns == columns and set(kept) == {r["doc_id"] for r in docs.collect() if machine.scores([(r["text"] or "").encode()], [(r["n_chars"],)])[0] >= 0.3}

    two = near(spark, one, sf)
    sets = {d: minhash.shingles((t or "").encode()) for d, t in kept.items()}
    groups = minhash.Forest()
    for i in sorted(sets):
        groups.root(i)
        for j in sorted(sets):
            if j < i and minhash.linked(sets[i], sets[j]):
                groups.join(i, j)
    assert two.columns == columns and set(text(two)) == {i for i in sets if groups.root(i) == i}

    three = bench(spark, two, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    windows = {}
    for r in items:
        w = plain_words((r["text"] or "").encode())
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(size, set()).add(tuple(w[i : i + size]))
    clean = set()
    for d, t in text(two).items():
        w = plain_words((t or "").encode())
        hit = {p for size, known in windows.items() for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in known for p in range(i, i + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(d)
    assert three.columns == columns and set(text(three)) == clean and len(clean) < len(text(two))

    four = private(spark, three, sf)
    before, after = text(three), text(four)
    assert four.columns == columns and set(after) == set(before)
    assert {d for d in after if after[d] != before[d]}
    assert four.where("n_chars <> length(text)").count() == 0

    packed = pack(spark, four, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_run_and_items_digest(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert decontaminate.items_digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty texts, repeated rows and empty tables go through every stage; columns stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27), (None, "no id here but words enough", "en", None, 27), (4, "mail a@b.co now", "en", "s", 15)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "packing":
                assert out.agg({"length": "sum"}).first()[0] == (None if not n else out.select("doc_id", "doc_tokens", "start").where("start = 0").agg({"doc_tokens": "sum"}).first()[0])
            else:
                assert out.columns == docs.columns and out.count() <= n
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, schema), sf)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 2, 3, 3, 4]
    private = dict(corpus_pipeline.STAGES)["pii"](spark, spark.createDataFrame(rows, schema), sf)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in private.where("doc_id = 4 or text is null").collect()} == {(4, "mail [EMAIL] now", 16), (1, None, None)}
