import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from octaframe.llm import common, lines, mixing, packing, toxicity
from tests.llm.test_minhash import brute
from tests.llm.test_text_operators import brute_pack
from tests.llm.test_toxicity import brute as brute_likelihoods

SF = "/root/testdata/sf0.001"


def in_sql(docs, sql, copies=False):
    """Rows of a query over docs as the table documents; with copies of a text under the smallest of their ids."""
    if copies:
        least = docs.groupBy(F.col("text").alias("t")).agg(F.min("doc_id").alias("least"))
        docs = docs.join(least, F.col("text").eqNullSafe(F.col("t")))
        docs = docs.select(F.when(F.col("text").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("doc_id"), "text").distinct()
    con = duckdb.connect()
    con.register("rows", docs.toArrow())
    con.sql("CREATE TABLE documents AS SELECT * FROM rows")
    return con.sql(sql).fetchall()


@pytest.fixture(scope="module")
def tables(spark):
    """The input of each stage, and the last result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.cut(stage(spark, out[-1], SF), "test"))
    return out


def test_stages_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    assert all(t.dtypes == tables[0].dtypes for t in tables[:5]) and all(t.count() for t in tables)


def test_toxic_documents_go(spark, tables):
    scored = toxicity.score(tables[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in scored.where("predicted = 0").collect()) == sorted(r.doc_id for r in tables[1].collect())


def test_toxic_documents_by_brute_force(spark, tables):
    """Both likelihoods by dictionaries, the curve by plain gradient steps, the verdict by its sign."""
    rows = [(r.doc_id, r.text, None) for r in tables[0].collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    x = np.array(brute_likelihoods(rows, labels))
    known = {i: t for i, t in labels if i is not None and t is not None}
    fit = [k for k, r in enumerate(rows) if r[0] in known and zlib.crc32(str(r[0]).encode()) % 5 == toxicity.FIT_FOLD]
    y = np.array([known[rows[k][0]] for k in fit], float)
    middle, width = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-12
    a = np.c_[np.ones(len(x)), (x - middle) / width]
    beta = np.zeros(3)
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-a[fit] @ beta))
        beta -= 0.2 * (a[fit].T @ (p - y) + np.array([1e-6, 1e-2, 1e-2]) * beta) / len(fit)
    z = a @ beta
    sure = {rows[k][0]: z[k] < 0 for k in range(len(rows)) if abs(z[k]) > 0.05}  # gradient steps end near the curve
    stays = {r.doc_id for r in tables[1].collect()}
    assert len(sure) > 0.95 * len(rows) and all((i in stays) == clean for i, clean in sure.items())


def test_recurring_lines_go(tables):
    texts, want = {}, {}
    for r in tables[1].collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    same = {i: min(ids) if t is not None else i for t, ids in texts.items() for i in ids}
    kept = {doc: (dropped, text) for doc, _, dropped, text in in_sql(tables[1], lines.ORACLE, copies=True)}
    for i, first in same.items():
        dropped, text = kept[first]
        if not dropped or text.split():
            want[i] = text
    assert {r.doc_id: r.text for r in tables[2].collect()} == want
    changed = {r.doc_id: r for r in tables[2].collect()}
    assert all(r.n_chars == len(r.text) for r in changed.values() if r.text != {x.doc_id: x.text for x in tables[1].collect()}[r.doc_id])


def test_one_of_each_group_stays(tables):
    groups = brute([(r.doc_id, r.text) for r in tables[2].collect()])
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_sources_are_mixed(tables):
    want = Counter()
    for doc, size, _, _, taken in in_sql(tables[3], mixing.ORACLE):
        want[doc] += taken // size if size else 0
    assert Counter(r.doc_id for r in tables[4].collect()) == +want


def test_packing_by_brute_force(spark, tables):
    """One shard: best fit that looks at every open sequence."""
    sized = sorted((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in tables[4].collect())
    top = max(packing.CAPACITIES)
    pieces = [(i, min(top, n - at)) for i, n in sized for at in range(0, n, top)]
    bins, caps = brute_pack([n for _, n in pieces], packing.CAPACITIES)
    want = Counter((i, n, b, caps[b]) for (i, n), b in zip(pieces, bins))
    assert Counter((r.doc_id, r.length, r.bin_id, r.capacity) for r in tables[5].collect() if r.length) == want


def test_all_words_are_packed(tables):
    words, packed = Counter(), Counter()
    for r in tables[4].collect():
        words[r.doc_id] += len(r.text.split())
    fill, caps = Counter(), {}
    for r in tables[5].collect():
        packed[r.doc_id] += r.length
        fill[r.bin_id] += r.length
        caps[r.bin_id] = r.capacity
    assert packed == words and all(fill[b] <= caps[b] for b in caps)


def test_run_gives_the_rows_of_the_stages(spark, tables):
    key = lambda df: sorted((r.doc_id, r.piece, r.length) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(tables[5])


HARD = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, _copy long, predicted string, mix_size string, _key long, c0 string"


def hard_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and names that the operators use themselves."""
    more = ("mine", "l", 7, "p", "m", 3, "c")
    long = " ".join(f"w{k % 977}q{k}" for k in range(30_000))
    rows = [(1, "some words that stay here now", "en", "s", 29), (1, "some words that stay here now", "en", "s", 29), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id at all but words to read", "en", "s", 31)]
    rows += [(4, long, "de", "t", len(long)), (5, "\n \n", "en", "s", 3), (6, "other words are quite unlike those of number one", "en", None, 48), (6, "one id with a second text that is like nothing else", "en", "t", 51)]
    return [(*r, *more) for r in rows]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_hard_rows(spark, name, stage):
    docs = spark.createDataFrame(hard_rows(), HARD)
    got = common.cut(stage(spark, docs, SF), "hard")
    rows = got.collect()
    if name == "packing":
        assert Counter((r.doc_id, r.length) for r in rows if r.length)[(4, 8192)] == 3
        assert sum(r.length for r in rows) == sum(len(r[1].split()) for r in hard_rows() if r[1])
    else:
        assert got.dtypes == docs.dtypes
        ids = Counter((r.doc_id, r.text) for r in rows)
        whole = {(r[0], r[1]) for r in hard_rows()}
        assert set(ids) <= whole and {tuple(r)[5:] for r in rows} == {hard_rows()[0][5:]}
        if name in ("toxicity", "line dedup"):
            assert len(rows) == len(hard_rows())
        if name == "near dedup":
            assert set(ids) == whole and set(ids.values()) == {1}
        if name == "mixing":
            assert all(r.text and r.text.split() for r in rows) and rows
    empty = stage(spark, docs.limit(0), SF)
    assert empty.collect() == [] and (name == "packing" or empty.dtypes == docs.dtypes)


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (8, a), (8, b), (9, b + " more"), (None, c), (None, c), (None, b), (7, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r.text.split()[0] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert got == {"a0": 1, "b0": 1, "c0": 1}


def test_runs_do_not_share_scratch(spark):
    """Tables of a stage go when it ends, and no others."""
    before = common.cut(spark.range(3), "outside")
    with common.scratch(spark):
        inner = common.new_path(spark, "inside")
        spark.range(2).write.parquet(inner)
        with common.scratch(spark):
            common.cut(spark.range(1), "deeper")
        assert spark.read.parquet(inner).count() == 2
    assert before.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner).count()


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (3, None, None, None, None), (None, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, None]


def test_copies_are_still_copies_after_line_dedup(spark):
    """A copy loses the lines that its original loses, and no more; the next stage then drops it whole."""
    own = [" ".join(f"own{d}word{k}" for k in range(20)) for d in range(4)]
    passage = " ".join(f"passage{k}" for k in range(60))
    texts = [f"{own[0]}\n{passage}", f"{own[0]}\n{passage}", f"{passage}\n{own[1]}", f"{passage}\n{own[1]}", f"{own[2]}\n{own[3]}", f"{own[2]}\n{own[3]}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = common.cut(corpus_pipeline.drop_recurring_lines(spark, docs, ""), "copies")
    assert {r.doc_id: r.text for r in got.collect()} == {0: texts[0], 1: texts[0], 2: own[1], 3: own[1], 4: texts[4], 5: texts[4]}
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, got, "").collect()) == [0, 2, 4]
