"""Toxicity by weak supervision.

Voters are terms and patterns that fire on a text: fixed lists, and terms
learned from labelled training rows (starts of words that occur in labelled
toxic texts and hardly in others). A generative label model, fitted by EM,
estimates each voter's rates of firing on toxic and clean texts and, from what
those leave unexplained, which voters fire together; correlated voters share
their weight. Its posterior labels train a linear classifier, which scores
every text.

Terms, label model and classifier are fitted on labelled rows of the training
part: all of them, or the SAMPLE with the least hashes of doc_id where there
are more. Scoring reads all texts whole.

Defined results: null and empty texts get the score of a text on which nothing
fires; without labels, fixed voters with fixed weights score; rows with equal
doc_id are scored each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import give_back, materialize, small_table

SAMPLE = 16_000
CHANCE = 0.05
THRESHOLD = 0.7
# Insults that name a person or a thing, matched at word starts.
LEXICON = tuple(
    "idiot moron imbecile stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk creep pig vermin filth coward liar".split()
)
# Hostile phrases, matched at word starts.
PHRASES = ("shut up", "go away", "get lost", "drop dead", "hate you", "kill you", "nobody likes", "you are a", "you people")
# Patterns of form, matched anywhere.
PATTERNS = (r"!{2,}", r"\b[A-Z]{4,}\b", r"(\*{2,}|[$#@%&]{2,})", r"(.)\1{4,}")
FOLDS, OUT = 3, 1


def fold(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(OUT))


class Voters:
    """Counts how often each voter fires on a text."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.n = len(terms) + len(PATTERNS)

    def open(self) -> Voters:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.patterns = [re.compile(p) for p in PATTERNS]
        return self

    def count(self, text: str) -> dict[int, int]:
        low, out = text.lower(), {}
        if self.terms:
            for end, (i, n) in self.automaton.iter(low):
                at = end - n
                if at < 0 or not low[at].isalnum():
                    out[i] = out.get(i, 0) + 1
        for k, p in enumerate(self.patterns):
            if p.search(text):
                out[len(self.terms) + k] = 1
        return out


_WORD = re.compile(r"[^\W\d_]{4,}")


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and label (_y) of the labelled rows of the training part: those of
    the `sample` least hashes of doc_id."""
    rows = labels.where((fold() != OUT) & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    least = rows.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample).collect()
    known = small_table(docs.sparkSession, [tuple(r) for r in least], "_id long, _y int")
    found = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("_d") == F.col("_id"))
    return materialize(found.select("text", "_y"), "labelled")


def learn_terms(marked: DataFrame) -> list[str]:
    """Word starts (4 to 8 letters) and words of labelled toxic training texts
    that are rare in the clean ones, and so beyond chance among all tried:
    of starts in the same texts, the longest. How many texts must hold a term
    follows from that test alone, so a small language's terms count, too."""

    def mine(batches):
        seen, totals = (Counter(), Counter()), [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set(_WORD.findall((text or "").lower()))
                seen[y].update({w[:k] for w in found for k in range(4, min(len(w), 8) + 1)} | found)
                totals[y] += 1
        terms = list(set(seen[0]) | set(seen[1]))
        if sum(totals):
            yield pa.RecordBatch.from_arrays(
                [pa.array(["", *terms]), *(pa.array([totals[y], *(seen[y][t] for t in terms)], pa.int64()) for y in (1, 0))], names=["term", "toxic", "clean"]
            )

    counts = materialize(
        marked.mapInArrow(mine, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "terms",
    )
    total = counts.where("term = ''").first()
    if total is None or not total.toxic or not total.clean:
        return []
    ratio = (F.col("toxic") + 0.5) / (total.toxic + 1) / ((F.col("clean") + 0.5) / (total.clean + 1))
    share = total.toxic / (total.toxic + total.clean)
    texts = F.col("toxic") + F.col("clean")
    terms = counts.where(F.col("term") != "")
    sizes = Counter(dict(terms.groupBy(texts.alias("n")).count().collect()))  # a row per number of texts
    least, tried = testable(sizes, share)
    good = (
        terms.where((F.col("toxic") >= least) & (F.col("toxic") > 9 * F.col("clean")) & (ratio > 8))
        .orderBy(F.col("toxic").desc(), F.length("term").desc(), "term")
        .collect()  # terms in `least` of the sample's toxic texts
    )
    good = [r for r in good if by_chance(r.toxic, r.toxic + r.clean, share) * tried < CHANCE]
    out: dict[str, None] = {}
    starts: set[str] = set()  # of those in out
    for r in good:
        if r.term not in starts and not any(r.term[:k] in out for k in range(1, len(r.term))):
            out[r.term] = None
            starts.update(r.term[:k] for k in range(1, len(r.term) + 1))
    return list(out)


def testable(sizes: dict[int, int], share: float) -> tuple[int, int]:
    """The fewest texts in which a term can be beyond chance, and how many terms
    are in so many: a term in fewer can't pass however toxic its texts, so it
    isn't among the tried (Tarone). sizes: number of terms by number of texts."""
    least, tried = 1, sum(sizes.values())
    while share**least * tried >= CHANCE:
        tried -= sizes.get(least, 0)
        least += 1
    return least, tried


def by_chance(hits: int, n: int, share: float) -> float:
    """P(at least `hits` of n texts are toxic) if a term tells nothing."""
    a, b, whole = math.log(share), math.log1p(-share), math.lgamma(n + 1)
    return math.fsum(math.exp(whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b) for i in range(hits, n + 1))


def label_model(votes: np.ndarray, trusted: np.ndarray, prior: float = 0.1, rounds: int = 50, times: np.ndarray | None = None):
    """EM on a 0/1 matrix (texts x voters), or one of distinct rows and how many
    times each occurs. A voter that doesn't fire abstains; that no trusted voter
    fires is a vote of its own. trusted: voters whose firing starts a text off
    as likely toxic. Returns posteriors, rates (voters x 2) and the voters'
    correlations beyond their rates (voters x voters)."""
    silent = ~votes[:, trusted].any(axis=1) if trusted.any() else np.zeros(len(votes), dtype=bool)
    x = np.hstack([votes, silent[:, None]])
    n, k = x.shape
    many = np.ones(n) if times is None else times.astype(float)
    post = np.where(silent, 0.02, 0.95) if trusted.any() else np.full(n, prior)
    together, rates = np.zeros((k, k)), np.zeros((k, 2))
    for step in range(rounds):
        yes, no = post * many, (1 - post) * many
        rates[:, 1] = (x.T @ yes + 0.1) / (yes.sum() + 1)
        rates[:, 0] = (x.T @ no + 0.1) / (no.sum() + 1)
        share = np.clip(yes.sum() / many.sum() if n else prior, 0.005, 0.5)
        if step % 4 == 3:  # with the posteriors of by now
            # Correlation within a class: firing together that rates leave over.
            rest = np.zeros((k, k))
            for y, p in ((1, yes), (0, no)):
                z = (x - rates[:, y]) * np.sqrt(p)[:, None]
                sd = np.sqrt(np.maximum((z * z).sum(axis=0), 1e-9))
                rest = np.maximum(rest, z.T @ z / np.outer(sd, sd) - 3 / np.sqrt(max(p.sum(), 1)))
            np.fill_diagonal(rest, 0)
            rest[:, -1] = rest[-1] = 0
            together = np.clip(rest, 0, 1)
        # Voters that fire together on a text share their evidence there.
        shared = x / (1 + x @ together)
        logit = np.log(share / (1 - share)) + shared @ np.log(rates[:, 1] / rates[:, 0])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step % 4 == 3 and n and np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post, rates[:-1], together[:-1, :-1]


def features(counts: dict[int, int], n: int, strong: np.ndarray) -> np.ndarray:
    x = np.zeros(n + 2)
    for i, c in counts.items():
        x[i] = min(c, 4) ** 0.5
    hits = sum(c for i, c in counts.items() if strong[i])
    x[n], x[n + 1] = hits > 0, np.log1p(hits)
    return x


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on soft labels by damped Newton steps, of rows that
    occur so many times; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    many = np.ones(len(x)) if times is None else times.astype(float)
    ridge = np.full(x.shape[1], penalty * max(many.sum(), 1))
    ridge[-1] *= 0.01
    mean = np.clip(many @ y / many.sum() if len(y) else 0.1, 0.001, 0.999)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(mean / (1 - mean))

    def loss(w):
        z = x @ w
        return many @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w * w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (many * (p - y)) + ridge * w
        step = np.linalg.solve((x * (many * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-7 * abs(last) + 1e-9:
            break
    return w


class Classifier:
    """The linear model over `features`, summed voter by voter."""

    def __init__(self, voters: Voters, weights: np.ndarray, strong: np.ndarray):
        self.voters, self.weights, self.strong = voters, weights.tolist(), strong.tolist()
        self.empty = self._squash(self.weights[-1])

    @staticmethod
    def _squash(z: float) -> float:
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def score(self, text: str | None) -> float:
        counts = self.voters.count(text) if text else {}
        if not counts:
            return self.empty
        w, n = self.weights, self.voters.n
        hits = sum(c for i, c in counts.items() if self.strong[i])
        z = w[-1] + math.fsum(w[i] * min(c, 4) ** 0.5 for i, c in counts.items())
        return self._squash(z + (w[n] + w[n + 1] * math.log1p(hits) if hits else 0.0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    train = labelled(docs, labels, sample)
    learned = learn_terms(train)
    terms = learned + [t for t in (*LEXICON, *PHRASES) if not any(t.startswith(x) for x in learned)]
    voters = Voters(terms)

    def vote(batches):
        v = voters.open()
        for b in batches:
            seen = Counter(tuple(sorted(v.count(t or "").items())) for t in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([[x for p in r for x in p] for r in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"]
            )

    # Texts on which the same voters fire as often are one row.
    fired = train.select("text").mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most `sample` rows
    counts = [dict(zip(r.votes[::2], r.votes[1::2], strict=True)) for r in fired]
    times = np.array([r.n for r in fired])
    votes = np.zeros((len(counts), voters.n))
    for i, c in enumerate(counts):
        votes[i, list(c)] = 1
    trusted = np.zeros(voters.n, dtype=bool)
    trusted[: len(learned) or len(LEXICON)] = True
    post, rates, _ = label_model(votes, trusted, times=times)
    # A strong voter fires on toxic texts many times as often as on clean ones.
    strong = (rates[:, 1] > 8 * rates[:, 0]) & (votes.sum(axis=0) > 0)
    if not len(counts):
        strong[:] = trusted
    x = np.array([features(c, voters.n, strong) for c in counts]).reshape(len(counts), voters.n + 2)
    weights = fit_linear(x, post, times=times) if len(counts) else np.append(np.zeros(voters.n + 2), -2.0)
    if not len(counts):
        weights[voters.n] = 4.0  # a strong voter fired
    return Classifier(voters, weights, strong)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """Every row of docs with `toxicity` (0 to 1) added."""
    from pyspark.sql import types as T

    text = docs.columns.index("text")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "toxicity"), T.StructField("toxicity", T.DoubleType())])
    keep = [i for i, c in enumerate(docs.columns) if c != "toxicity"]

    def run(batches):
        model.voters.open()
        for b in batches:
            s = [model.score(t) for t in b.column(text).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(s)], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    model = fit(docs, labels, sample)
    out = scored(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select(
        "doc_id",
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)) == OUT).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = scored(docs, fit(docs, labels, sample))
    return out.where(F.col("toxicity") < THRESHOLD).select(*docs.columns) if "toxicity" not in docs.columns else _beside(docs, labels, sample)


def _beside(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """docs has a column toxicity of its own: score under another name."""
    renamed = docs.withColumnRenamed("toxicity", "_toxicity_in")
    return reject_toxic(renamed, labels, sample).withColumnRenamed("_toxicity_in", "toxicity")
