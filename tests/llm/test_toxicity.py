import math
import random
import re
from collections import Counter, defaultdict

import pytest

from octaframe.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["Vilex!", "crassic", "foulin,"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_hard_rows(spark):
    rows, labels = corpus()
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, "vilex " * 30_000, None), (None, "plain", "x"), (7, rows[7][1], "x")]
    labels += [(None, 1), (7, None), (7, 0), (8, 1)]
    got = toxicity.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:1500])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score and not by[None].held_out


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, DOCS)
    a = toxicity.score(docs, spark.createDataFrame(labels, LABELS), keep=["doc_id"])
    held = {r.doc_id for r in a.where("held_out").collect()}
    flipped = [(i, 1 - t if i in held else t) for i, t in labels]
    b = toxicity.score(docs, spark.createDataFrame(flipped, LABELS), keep=["doc_id"])
    assert sorted((r.doc_id, round(r.score, 9)) for r in a.collect()) == sorted((r.doc_id, round(r.score, 9)) for r in b.collect())


def test_all_labelled_rows_are_counted(spark, monkeypatch):
    rows, labels = corpus(600)
    seen, counts = [], toxicity._word_counts
    monkeypatch.setattr(toxicity, "_word_counts", lambda some: seen.append(some.count()) or counts(some))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    toxicity.score(docs, known, keep=["doc_id"])
    assert seen == [known.where(toxicity.fold(known.doc_id).isin(*toxicity.COUNT_FOLDS)).count()]


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0]
    assert toxicity.score(docs.limit(0), none).collect() == []


def brute(rows, labels):
    """(mean, strength) of each text from both likelihoods, by dictionaries alone."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    words = lambda t: re.findall(r"\w{1,64}", (t or "").lower())
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 5
    label = defaultdict(int)
    for i, t in labels:
        if i is not None and t is not None:
            label[i] = max(label[i], t)
    pairs = {0: set(), 1: set()}
    for i, text, _ in rows:
        if i in label and fold(i) in toxicity.COUNT_FOLDS:
            w = words(text)
            pairs[label[i]].update(zip([None, *w], w))
    grams = lambda w: [("\2" + w + "\3")[max(0, k + 1 - order) : k + 1] for k in range(1, len(w) + 2)]
    c = {y: Counter() for y in pairs}
    for y in pairs:
        for _, w in pairs[y]:
            c[y].update(grams(w))
    seen = {g[-k:] for y in c for g in c[y] for k in range(1, len(g) + 1)}
    before = Counter(u[1:] for u in seen if len(u) > 1)
    followers = defaultdict(list)
    for s in before:
        followers[s[:-1]].append(s)
    after = {y: defaultdict(list) for y in c}
    for y in c:
        for g in c[y]:
            after[y][g[:-1]].append(g)

    def shorter(s):
        if not s:
            return 1 / (1 + len(followers[""]))
        n = sum(before[x] for x in followers[s[:-1]])
        return max(before[s] - d, 0) / n + d * len(followers[s[:-1]]) / n * shorter(s[1:])

    def p(y, g):
        b = g[:-1]
        pooled = set(after[0].get(b, ())) | set(after[1].get(b, ()))
        if not pooled:
            return 1.0  # the same for both
        n = sum(c[0][x] + c[1][x] for x in pooled)
        known = g in pooled  # what nobody has seen has the same backoff in both classes
        base = max(c[0][g] + c[1][g] - d, 0) / n + d * len(pooled) / n * shorter(g[1:]) if known else 1.0
        mine = after[y].get(b)
        if not mine:
            return base
        total = sum(c[y][x] for x in mine)
        return max(c[y][g] - d, 0) / total + d * len(mine) / total * base

    ratio = {}

    def word(w):
        if w not in ratio:
            toxic, plain = (sum(math.log(p(y, g)) for g in grams(w)) for y in (1, 0))
            ratio[w] = math.log(1 - toxicity.MIXED + toxicity.MIXED * math.exp(toxic - plain))
        return ratio[w]

    out = []
    for _, text, _ in rows:
        got = [word(w) for w in words(text)]
        out.append((sum(got) / max(len(got), 1), sum(got) / math.sqrt(max(len(got), 1))))
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_likelihoods_against_brute_force(spark, most):
    """Both ways of scoring: with the model sent to all workers, and by joins."""
    rows, labels = corpus(260, seed=9)
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, "vilexish crassic's \u4e2d\u6587 " * 50 + "q" * 200, None), (None, "\U0001f600 foulins e\u0301te", "x"), (5, rows[5][1], "x")]
    labels += [(5, 1), (9003, 1), (None, 0), (11, None)]
    docs = spark.createDataFrame([(k, *r[1:], r[0]) for k, r in enumerate(rows)], "nr long, text string, score string, doc_id long")
    got = toxicity.score(docs, spark.createDataFrame(labels, LABELS), keep=["nr"], most_entries=most).collect()
    want = brute(rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert (r.mean, r.strength) == pytest.approx(want[r.nr], rel=1e-7, abs=1e-9), rows[r.nr][1]


def test_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 5)], "doc_id long, text string, _sum string, c0 long")
    got = toxicity.score(docs, spark.createDataFrame([(2, 1)], LABELS))
    assert got.columns == ["doc_id", "text", "_sum", "c0", "held_out", "score", "predicted", "mean", "strength"]
    assert got.first()[:4] == (1, "a b", "mine", 5)
