import numpy as np

from octaframe.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def table(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = np.random.default_rng(i // 5).normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.15], i % 3, "x"))
    rows += [(n, rows[3][1], rows[3][2], None), (n + 1, [float(2 * np.float32(x)) for x in rows[3][1]], rows[3][2], "x")]
    nan, inf = float("nan"), float("inf")
    rows += [(n + 2, None, 1, "x"), (n + 3, [0.0] * 8, 1, "x"), (n + 4, [nan] * 8, 1, "x"), (n + 5, [inf] + [1.0] * 7, 1, "x")]
    rows += [(n + 6, [None] + [1.0] * 7, 1, "x"), (n + 7, rows[3][1], None, "x"), (n + 8, [], 1, "x"), (None, rows[3][1], rows[3][2], "x"), (n + 9, [1.0, 2.0], 1, "x")]
    return rows


def good(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def test_epsilon_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INTERVAL", 32)
    monkeypatch.setattr(vectors, "LEAF", 8)
    monkeypatch.setattr(vectors, "TILE_BYTES", 5000)
    rows = table(spark)
    got = {r.vec_id: tuple(r) for r in vectors.epsilon_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = {r[0]: set() for r in rows}
    for i, a, la, _ in rows:
        for j, b, lb, _ in rows:
            if i is not None and j is not None and i != j and la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].add(j)
    comp = {i: i for i in links if i is not None}
    for _ in range(50):
        comp = {i: min([c, *(comp[j] for j in links[i])]) for i, c in comp.items()}
    want = {i: (i, len(links[i]), c, i == c) for i, c in comp.items()} | {None: (None, 0, None, True)}
    assert got == want
    assert sum(len(x) for x in links.values()) > 250


def test_epsilon_join_empty(spark):
    assert vectors.epsilon_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(vectors, "QUERY_TILE", 3)
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, vectors.top_k(df, df.where("vec_id % 20 = 0")).collect()))
    q = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v, *_ in rows if i is not None and v is not None and (not v or good(v, True))}
    want = []
    for i, a in q.items():
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q.items() if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want)


def test_top_k_few_rows_ties_and_overflow(spark):
    rows = [(0, [1.0], 1, "x"), (2, [1.0], 1, "x"), (1, [1.0], 1, "x"), (3, [-1.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[1:3] for r in sorted(vectors.top_k(df, df.where("vec_id = 0")).collect())] == [(1, 1), (2, 2), (3, 3)]
    big = spark.createDataFrame([(0, [1e30, 1.0], 1, "x"), (1, [1e30, 0.0], 1, "x"), (2, [-1e30, 0.0], 1, "x")], SCHEMA)
    assert [(r.vec_id, r.score > 0) for r in sorted(vectors.top_k(big, big.where("vec_id = 0")).collect())] == [(1, True), (2, False)]
    assert vectors.top_k(df.limit(0), df.limit(0)).collect() == []
