"""BPE, conversation repair and fill-in-the-middle against plain versions of their rules."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrano.llm import bpe, conversation_repair as repair, fill_middle as fim

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, ids string, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.vocabulary_path())


def odd_texts():
    pick = random.Random(5)
    mixed = ["".join(pick.choice("abcdefgh  \n\t1!é漢\x1c '") for _ in range(60)) for _ in range(120)]
    wide = ["".join(chr(pick.choice([pick.randrange(32, 0x300), pick.randrange(0x300, 0x3000), pick.randrange(0x10000, 0x32400)])) for _ in range(40)) for _ in range(120)]
    return [
        "", " ", "  ", "\n", "a\n  b", "  lead", "trail  ", "trail ", "a \n b", "<|endoftext|>", "a <|endoftext|>  b\n\n<|endoftext|>", "a<|endoftext|>x ", "<|endoftext|",
        "I'll we've it's 'tis DON'T", "😀😀 tèxt", "՘₏ new letters", "aaaaaaaaaaaaaaaaaaaaa" * 40, "x" * 70_000, "".join(pick.choice("etaoin") for _ in range(30_000)), *mixed, *wide,
    ]


def test_encoder_equals_the_library(library, vocabulary):
    texts = odd_texts()
    encoder = bpe.Encoder(vocabulary, max_kept=200)  # forgets on the way
    for batch in (texts[:3], texts, list(reversed(texts))):
        ids, bounds = encoder.encode(batch)
        for i, text in enumerate(batch):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:60])
    assert 0 < encoder.exact < encoder.proposed  # both ways were taken


def test_every_word_class_is_cut_as_by_the_library(library, vocabulary):
    """All assigned and unassigned code points of the planes in use, between letters, digits and signs."""
    encoder, marks = bpe.Encoder(vocabulary), [c for c in range(0x3400) if not 0xD800 <= c <= 0xDFFF] + list(range(0xA000, 0xABFF)) + list(range(0x10900, 0x10A00))
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in marks[at : at + 400]) for at in range(0, len(marks), 400)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode([text])[0].tolist() == want.ids


def test_exact_merging_of_short_and_long_words_agrees(vocabulary):
    pick = random.Random(3)
    for _ in range(300):
        word = bytes(pick.choice(b"etaoinshrdlu \xc3\xa9") for _ in range(pick.randrange(1, 60)))
        short = vocabulary.merged(word)
        long = vocabulary.merged(word + b"\x00" * bpe.SHORT)  # no merge crosses a zero byte
        assert [t for t in long if t != 0] == short


def test_bpe_cases(spark, library):
    texts = [None, *odd_texts(), "the same", "the same"]
    docs = spark.createDataFrame([(i, t, "clash", "extra") for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(rows) == len(texts) and rows[3]["n"] == "extra"
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    ids = spark.createDataFrame([(1, [-1, 99_999_999, 31_373]), (2, None), (3, []), (4, [220, 195])], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids).collect()}
    assert back == {1: library.decode([31_373]), 2: None, 3: "", 4: library.decode([220, 195], skip_special_tokens=False)}
    assert bpe.digests(docs.limit(0)).count() == 0


def test_bpe_query_equals_the_library(spark, sf, library):
    from terrano.llm import queries

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == sha(",".join(map(str, ids))) and got[d]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# --- conversation repair


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): all ways by a full table of strings."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {"u": "user", "a": "assistant"}

    def more(best):
        """With turns inserted, until nothing gets better."""
        best, new = dict(best), dict(best)
        while new:
            found = {}
            for s, (c, a, r) in new.items():
                for i in "ua":
                    if (s, i) in step:
                        way, to = (c + 5, a + "I", (*r, full[i] + ":")), step[s, i]
                        if way < best.get(to, (9e9,)):
                            best[to] = found[to] = way
            new = found
        return best

    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, a, r) in more(best).items():
            ways = [(s, (c + 2, a + "D", r))]
            if fault in ("", "truncated"):
                c += 5 * (fault == "truncated")
                if (s, role[:1]) in step:
                    ways.append((step[s, role[:1]], (c, a + "K", (*r, f"{role}:{text}"))))
                ways += [(step[s, i], (c + 1, a + "R", (*r, f"{full[i]}:{text}"))) for i in "ua" if (s, i) in step]
            for to, way in ways:
                new[to] = min(new.get(to, (9e9,)), way)
        best = new
    cost, audit, left = min(w for s, w in more(best).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(left))


def random_rows(pick, n, conv):
    words = ["Yes.", "Yes.", "No", " ", "", "Why?", "Well!", None, "a b. \n", "one.", "two.", "three.", "four"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None]
    return [(conv, pick.choice([None, i, i, i, i + 1, i + 3]), pick.choice(roles), pick.choice(words)) for i in range(n)]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("rows_of", "fan"), [(512, 256), (3, 2), (1, 3)])
def test_repair_equals_all_ways(spark, rows_of, fan):
    """Also with blocks of a few rows and low fans, so that conversations span blocks, parts and levels."""
    pick = random.Random(11)
    rows = [r for conv in range(60) for r in random_rows(pick, pick.randrange(1, 9), conv)] + random_rows(pick, 300, None) + random_rows(pick, 90, 77)
    frame = spark.createDataFrame(rows, TURNS).withColumn("cost", F.lit("clash"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digests(frame, rows_of, fan).collect()}
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in rows if r[0] == c])
    if rows_of == 3:
        turns = sorted(((-1 if r["conv_id"] is None else r["conv_id"], r["at"], r["place"], r["role"], r["text"]) for r in repair.repair(frame, rows_of, fan).collect()))
        for c, w in want.items():
            assert sha("\n".join(f"{r}:{t}" for d, _, _, r, t in turns if d == (-1 if c is None else c))) == w[-1]
        assert repair.digests(frame.limit(0)).count() == 0


def test_crossings_are_the_least_of_all_ways():
    pick = random.Random(2)
    for n in range(1, 9):
        for _ in range(40):
            kinds = tuple((pick.choice(["s", "u", "a", ""]), pick.choice(["", "", "truncated", "blank"])) for _ in range(n))
            states = [0, *repair.crossings([repair.TABLES[k] for k in kinds], 0, repair.ENDING)]
            ways = [repair.WAYS[k][s, t] for k, s, t in zip(kinds, states, states[1:])]
            cost, audit = sum(w[0] for w in ways) + repair.ENDING[states[-1]], "".join(w[1] for w in ways) + "I" * (repair.ENDING[states[-1]] // 5)
            all_ways = {0: (0, "")}
            for k in kinds:
                new = {}
                for (s, t), (c, a, _) in repair.WAYS[k].items():
                    if s in all_ways:
                        new[t] = min(new.get(t, (9e9,)), (all_ways[s][0] + c, all_ways[s][1] + a))
                all_ways = new
            assert (cost, audit) == min((c + repair.ENDING[s], a + "I" * (repair.ENDING[s] // 5)) for s, (c, a) in all_ways.items())


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, r, x in ((0, "system", "Be kind."), (1, "user", "Hi. Ho!"), (2, None, "a?"), (None, "user", None), (3, "assistant", ""))]
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), sha(out), sha(text)


def test_borders_equal_the_units():
    pick = random.Random(9)
    for bits in (1, 3, 8):
        memo = fim.Memo(max_bytes=2000, bits=bits)
        for n in (0, 1, 2, 5, 40, 400):
            for _ in range(20):
                text = "".join(pick.choice("ab é漢😀\n\t  <>") for _ in range(n))
                units, borders = UNIT.findall(text), memo.borders(text.encode())
                assert borders.n == len(units)
                for k in range(len(units) + 1):
                    head = "".join(units[:k])
                    assert borders.place(k) == (len(head.encode()), len(head))


def test_shared_passages_share_chunks():
    pick = random.Random(4)
    words = ["".join(pick.choice("etaoinshrdlu") for _ in range(6)) for _ in range(900)]
    passage = " ".join(words).encode()
    memo = fim.Memo()
    memo.borders(passage)
    made = memo.made
    memo.borders(b"another beginning, " + passage + b" and another end")
    assert memo.made - made <= 4 < made


def test_fill_middle_cases(spark):
    texts = [None, "", " ", "\n\n", "one", " one ", "a<P>b c d", "<S>", "x < S > y", "<<P", "ünï cödé 😀 text\n", "y" * 5000, "z " * 70_000, *(f"some words <{i} of a> text number {i}\n  more" for i in range(80)), "copy of", "copy of"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "extra", "clash") for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in fim.digests(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_fim(i, t or "")) for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    out = fim.transform(docs, rate=100, suffix_first=0)
    assert out.where("form = 'spm'").count() == 0 and set(out.columns) == {"doc_id", "text", "ids", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert fim.digests(docs.limit(0)).count() == 0
