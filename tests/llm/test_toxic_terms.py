import math

from firnline.llm import toxicity


def test_small_languages_and_many_terms_are_learned(spark):
    """A term in 1% of the toxic texts, and more than 120 terms."""
    def word(k):
        return "".join(chr(97 + k // 26**i % 26) for i in range(3)) + "wort"

    texts = [(f"{word(k % 150)} common words here", 1) for k in range(3000)]
    texts += [("zażółć gęśląjaźń", 1)] * 20 + [("common words here", 0)] * 9000 + [("zażółć dobrze", 0)] * 60
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    terms = toxicity.learn_terms(toxicity.labelled(docs, labels))
    assert any("gęśląjaźń".startswith(t) for t in terms)
    assert all(any(word(k).startswith(t) for t in terms) for k in range(150))
    assert not any(x.startswith(t) for t in terms for x in ("common", "words", "here", "dobrze", "zażółć"))


def test_chance_is_exact():
    for hits, n, share in ((3, 10, 0.1), (30, 399, 0.11), (1, 1, 0.5)):
        assert math.isclose(toxicity.by_chance(hits, n, share), sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(hits, n + 1)), rel_tol=1e-9)
    assert toxicity.by_chance(60, 500, 0.11) > 0.2


def test_the_sample_is_exact_at_any_size(spark):
    """As many rows as asked for, whatever share of the table they are."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 9 = 0 as int) AS toxic").where(toxicity.fold() != toxicity.OUT)
    assert toxicity.labelled(docs, labels, 1).count() == 1
    assert toxicity.labelled(docs, labels, 777).count() == 777
    assert toxicity.labelled(docs, labels).count() == labels.count()


def test_held_out_accuracy(spark):
    """On texts whose labels are not read: no clean text is rejected, most
    toxic ones are, and scores rank them first."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.held_out_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [[r for r in got if r.toxic == y] for y in (1, 0)]
    assert not sum(r.predicted for r in clean)
    assert sum(r.predicted for r in toxic) > 0.5 * len(toxic)
    above = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert above > 0.8 * len(toxic) * len(clean)


def test_without_labels_fixed_voters_score(spark):
    docs = spark.createDataFrame([(1, "you are an idiot, shut up"), (2, "a calm text"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, none).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[2].score == got[3].score
