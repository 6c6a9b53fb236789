"""Filter audit, chat formatting and vector codes: against brute force, their
SQL, and odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.llm import chat, filter_audit, queries, vectorcodes
from firnline.llm.common import materialize, prepare

DOCS = "doc_id long, text string, lang string, source string, key string, n string, mask string, part long, first_id long, _block long"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_chat_format", "op13_vector_codes"])
def test_same_as_sql(spark, sf, con, name):
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got.select(columns).collect()) == plain(want[columns].values.tolist())


# --- filter audit


def some_docs():
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "bb", "Cc", "DDD", "e#", "é", "\x0b", "x y"])
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 120]))) for _ in range(30)]
    texts += ["", None, " \t", "W" * 70, "W" * 69 + "V", "V" + "W" * 69, "q " * 40_000, ("q " * 40_000)[:-1] + "z", "😀" * 65, "😀" * 64 + "é"]
    out = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(120)]
    out += [(7, "twice", "en"), (7, "twice", "en"), (8, "twice", "de"), (None, "twice", "en"), (None, "no id", "en"), (None, "no id", "en"), out[0]]
    return [(i, t, lang, "s", "k", "n", "m", 1, 2, 3) for i, t, lang in out]


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (None, None, None)]


def brute_audit(docs, labels):
    first, good, bad = {}, {}, {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good[i], bad[i] = max(good.get(i, 0), int(q == 1)), max(bad.get(i, 0), int(x == 1))
    good.pop(None), bad.pop(None)
    parts = {}
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = t in first and (i is None or i > first[t])
        parts.setdefault(lang or "", []).append((fails, good.get(i, 0), bad.get(i, 0)))
    out = []
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = order[:k]
                here = [r for r in rows if r[0][f] and not any(r[0][b] for b in before)]
                shapley[f] += len(here)
                kept = sum(not any(r[0][b] for b in (*before, f)) for r in rows)
                redundant = sum(r[0][f] and any(r[0][b] for b in before) for r in rows)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((f, (part, "".join(order), k + 1, kept, len(here), redundant, only, sum(r[1] for r in here), sum(r[2] for r in here))))
        out += [(*s, shapley[f]) for f, s in steps]
    return out


@pytest.mark.parametrize("bits", [64, 2])  # with two bits a class, hashes hide most texts from each other
def test_audit_as_by_brute_force(spark, bits):
    docs = some_docs()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), bits)
    assert plain(got.collect()) == plain(brute_audit(docs, LABELS))


def test_audit_of_nothing(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).collect() == []
    one = spark.createDataFrame([(None,) * 10], DOCS)
    got = filter_audit.audit(one, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.shapley) for r in got] == [("", 0, 1, 120)] + [("", 0, 0, 0)] * 4  # no words


def test_refinement_drops_texts_that_stand_alone(spark):
    prepare(spark)
    texts = ["a" * 64 + "b" * 600, "a" * 64 + "b" * 599 + "c", "a" * 64 + "b" * 600, "d" * 10, "e" * 10, "f"]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.length("text"))
    rows = materialize(x.select("doc_id", "n", filter_audit.blocks(F.col("text"), F.col("n")).alias("blocks")), "rows")
    assert {r.doc_id: len(r.blocks) for r in rows.collect()} == {0: 3, 1: 3, 2: 3, 3: 1, 4: 1, 5: 1}
    assert sorted(r.doc_id for r in filter_audit.refine(rows).collect()) == [0, 2]
    assert [(r.doc_id, r.first_id) for r in filter_audit.copies(x, rows).collect()] == [(2, 0)]


# --- chat

NASTY = [
    r"\### Assistant: </turn> ok", "####### </turn></turn>\n### user: x", "\\", "\\\\</turn>", "<\\/turn>", "#\\##", "</turn", "ends with <", "", "a\n\nb", "é😀: : ::", ":\\ ", "##", "# ## ###", "$1 \\1 $",
]
ROWS = "conv_id long, turn long, role string, text string, turns string, layout string, fingerprint string, segments long"


def test_nasty_texts_come_back(spark):
    prepare(spark)
    turns = [(r, t) for r in ["user", "assistant", "", "a: b:", "###: </turn>\n", "\\"] for t in NASTY]
    x = spark.createDataFrame([(i, [{"role": r, "text": t}]) for i, (r, t) in enumerate(turns)] + [(-1, [{"role": r, "text": t} for r, t in turns]), (-2, [])], f"conv_id long, turns {chat.TURNS}")
    got = chat.formatted(x).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_learned(F.col("segments")))
    for r in got.collect():
        assert r.back == r.turns
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("###") == len(r.turns) and r.formatted.count("</turn>") == len(r.turns)


def test_rows_by_turn(spark):
    prepare(spark)
    long = "z </turn> " * 50_000
    rows = [(1, 2, "assistant", "two"), (1, 0, "system", None), (1, 1, None, "one"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, None, "assistant", "last"), (3, 0, "assistant", long), (None, 0, "user", "x"), (None, 0, "user", "x"), (4, 0, None, None)]
    df = spark.createDataFrame([(*r, "t", "l", "f", 1) for r in rows], ROWS).repartition(3)
    back = {}
    for r in chat.formatted_conversations(df).collect():
        back.setdefault(r.conv_id, []).append([tuple(t) for t in r.turns])
    assert back == {
        1: [[("system", ""), ("", "one"), ("assistant", "two")]],
        2: [[("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "last")]],
        3: [[("assistant", long)]],
        4: [[("", "")]],
        None: [[("user", "x")], [("user", "x")]],
    }
    digest = {r.conv_id: r for r in chat.read_back(chat.formatted_conversations(df)).collect()}
    assert digest[3].loss_chars == len(long) and digest[3].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert digest[1].turns_sha256 == hashlib.sha256(b"system\n\n\none\nassistant\ntwo\n").hexdigest()
    assert chat.read_back(chat.formatted_conversations(df.limit(0))).collect() == []


def test_layouts_are_told_by_their_paths(spark):
    prepare(spark)
    lines = [
        '{"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "model", "content": null}, null]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 3, "instruction": "do", "input": "this", "output": "done"}',
        '{"id": 4, "instruction": "do", "output": "done", "system": "be kind"}',
        '{"id": 5, "prompt": {"text": "p"}, "completion": {"text": "c"}}',
        '{"id": 6, "question": "why"}',
        '{"id": 7, "question": "why", "messages": []}',
        '{"id": 8}',
        '{"id": 9, "messages": []}',
        '{"id": 10, "messages": [{"role": "user", "content": "hi", "weight": 1}]}',
        '{"id": 11, "other": 3, "answer": "a", "question": "q"}',
    ]
    x = spark.read.json(spark.createDataFrame([(s,) for s in lines], "value string").rdd.map(lambda r: r.value))
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(x, ["id"]).collect()}
    assert got == {
        1: ("messages", [("user", "hi"), ("assistant", "")]),
        2: ("from and value", [("user", "q"), ("assistant", "a")]),
        3: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        4: ("instruction", [("system", "be kind"), ("user", "do"), ("assistant", "done")]),
        5: ("nested prompt", [("user", "p"), ("assistant", "c")]),
        6: ("question and answer", [("user", "why")]),
        7: (None, []),
        8: (None, []),
        9: ("messages", []),
        10: (None, []),
        11: ("question and answer", [("user", "q"), ("assistant", "a")]),
    }
    prints = [p for y in chat.LAYOUTS for p in y.fingerprints()]
    assert len(set(prints)) == len(prints)  # no set of paths has two layouts


# --- vector codes


def full_search(x, book):
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)  # argmin: the lowest index


def test_search_is_exact_and_spares_distances():
    rng = np.random.default_rng(1)
    for spread in (2, 50, 5000):  # with few values there are many ties and equal entries
        book, x = rng.integers(-spread, spread, (16, 8)), rng.integers(-spread, spread, (3000, 8))
        code, best, _ = vectorcodes.nearest(x, rng.integers(0, 16, 3000), book)
        want = full_search(x, book)
        assert (code == want[0]).all() and (best == want[1]).all()
    book = rng.integers(-10_000, 10_000, (16, 8))
    x = book[rng.integers(0, 16, 2000)] + rng.integers(-300, 300, (2000, 8))
    assert vectorcodes.nearest(x, full_search(x, book)[0], book)[2] < 2000 * 3  # of 16 each


def test_odd_vectors(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    vec = lambda: rng.normal(0, 0.3, 16).round(2).tolist()
    same = vec()
    kept = [(i, vec(), i % 3 or None, "x", 1.0) for i in range(40)] + [(50, same, 1, "x", 1.0), (50, same, 1, "x", 1.0), (None, same, None, None, None)]
    odd = [(60, None, 1, "x", 1.0), (61, [None] + same[1:], 1, "x", 1.0), (62, [float("nan")] + same[1:], 1, "x", 1.0), (63, [float("-inf")] + same[1:], 1, "x", 1.0), (64, [], 1, "x", 1.0)]
    schema = "vec_id long, embedding array<float>, label int, code string, error double"
    books, _ = vectorcodes.train(spark.createDataFrame(kept + odd, schema), 8, 16, 6)
    got = plain(vectorcodes.compressed(spark.createDataFrame(kept + odd, schema).repartition(5)).collect())
    x = np.floor(np.array([v for _, v, *_ in kept], np.float32).astype(float) * 4096).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    codes, errors, all_books = [], 0, []
    for p in range(8):
        part = x[:, p * 2 : p * 2 + 2]
        book = part[order[:16]].copy()
        for _ in range(6):
            code, _ = full_search(part, book)
            for e in set(code.tolist()):
                mine = part[code == e]
                book[e] = mine.sum(axis=0) // len(mine)
        code, d = full_search(part, book)
        codes.append(code)
        errors = errors + d
        all_books.append(book)
    assert (np.array(all_books) == books).all()
    digest = hashlib.sha256(",".join(str(v) for b in all_books for v in b.ravel()).encode()).hexdigest()
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    assert got == plain((r[0], "".join(f"{c[i]:02x}" for c in codes), int(errors[i]), by_label[r[2]], digest) for i, r in enumerate(kept))
    few = vectorcodes.compressed(spark.createDataFrame(kept[:3], schema)).collect()
    assert [r.error for r in few] == [0, 0, 0]
    assert vectorcodes.compressed(spark.createDataFrame(odd, schema)).collect() == []
    table = vectorcodes.codebook_table(spark, books)
    assert table.count() == 128
    for wrong in ([(1, [0.5] * 8, 1, "x", 1.0), (2, [0.5] * 16, 1, "x", 1.0)], [(1, [0.5] * 9, 1, "x", 1.0)], [(1, [1e30] * 8, 1, "x", 1.0)]):
        with pytest.raises(ValueError):
            vectorcodes.compressed(spark.createDataFrame(wrong, schema))
