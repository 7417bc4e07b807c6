import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaframe.llm import components as components_module
from octaframe.llm import minhash
from octaframe.llm.components import components

SCHEMA = "doc_id long, text string, component_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.3 else "\t".join(text), "x"))
    # A loose family: neighbours are similar, far members are not.
    chain = [word() for _ in range(120)]
    for k in range(60):
        chain = chain[2:] + [word(), word()]
        rows.append((len(rows), " ".join(chain), None))
    rows += [(len(rows) + k, t, "x") for k, t in enumerate([None, "", " \n ", "one two", "ONE  two", "x" * 50_000, "é É"])]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_one_large_loose_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SETS", 8)
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(4):
            text[rng.randrange(100)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(text), None))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_nulls_repeats_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, "x"), (3, long, "x"), (3, long, "x"), (7, long, None), (8, "other words are here now", "x"), (8, long, "x")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 36, None, True), (3, 36, 3, True), (3, 36, 3, True), (7, 36, 3, False), (8, 1, 3, False), (8, 36, 3, False)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    mul, add = minhash._constants()
    for share in (0.75, 0.9, 1.0):
        errors = []
        for _ in range(20):
            a = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
            common = int(round(800 * 2 * share / (1 + share)))
            b = np.r_[a[:common], rng.integers(0, 1 << 63, 800 - common, dtype=np.uint64)]
            s = minhash._sketches(minhash._minima([a, b], mul, add))
            errors.append(float(minhash.estimate(np.bitwise_count(s[0] ^ s[1]).sum())) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_components(spark, monkeypatch, piece):
    monkeypatch.setattr(components_module, "PIECE", piece)
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {100: 0, 200: 200, 201: 200} | {1000 + k: 1000 for k in range(300)}
    assert got == want


@pytest.mark.parametrize("ids", ["hashed", "outlier"])
def test_ids_of_any_spread(spark, monkeypatch, ids):
    """Copies of one text with a few edits, under ids all over the range of a long, or close ones and one far away."""
    rng = random.Random(8)
    n = 400 if ids == "hashed" else 3000
    names = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] if ids == "hashed" else [-(1 << 62), *range(1 << 61, (1 << 61) + n - 1)]
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(90)] = f"x{rng.random()}"
        texts.append(text)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    docs = spark.createDataFrame([(i, " ".join(t), None) for i, t in zip(names, texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    # All sets against all others, by one product of matrices over the shingles that several texts have.
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    counts = {}
    for x in sets:
        for t in x:
            counts[t] = counts.get(t, 0) + 1
    place = {t: k for k, t in enumerate(t for t, c in counts.items() if c > 1)}
    m = np.zeros((n, len(place)), np.float32)
    for i, x in enumerate(sets):
        m[i, [place[t] for t in x if t in place]] = 1
    size = np.array([len(x) for x in sets])
    rank = np.argsort(np.argsort(names))
    by = np.argsort(names)
    label = rank.copy()
    links = []
    for at in range(0, n, 500):
        common = m[at : at + 500] @ m.T
        i, j = np.nonzero(100 * common >= 75 * (size[at : at + 500, None] + size[None, :] - common))
        links.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*links))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        if (low == label).all():
            break
        label = low
    assert got == {names[k]: names[by[label[k]]] for k in range(n)}


def test_units_of_wide_buckets_are_even(spark):
    """The place of a member depends on a hash: an outlier or a run of ids does not fill one unit."""
    n = 40_000
    ids = spark.range(n).select(F.when(F.col("id") == 0, F.lit(-(1 << 63))).otherwise(F.col("id")).alias("id"))
    units = -(-n // minhash.BLOCK)
    got = ids.groupBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(units))).count().agg(F.max("count")).first()[0]
    assert got < 2 * minhash.BLOCK


def test_texts_of_no_number_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("7", long, 1), ("x", long, 2), ("9", long, 3)], "_id string, text string, component_id long")
    got = sorted(map(tuple, minhash.near_duplicates(docs, id_col="_id").collect()), key=str)
    assert got == sorted([(7, 36, 7, True), (None, 36, None, True), (9, 36, 7, False)], key=str)
