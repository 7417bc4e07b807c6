"""Registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import licenses, lines, minhash, mixing, packing, toxicity, urls, vectors, warc
from .common import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(mixing.ORACLE)
def op1_pareto_mix(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").cast("double").alias("target"),
        F.col("mix_taken").cast("long").alias("taken"),
    )


@query()
def op5_odd_sketch_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(vectors.EPSILON_ORACLE)
def op3_epsilon_grid_join(spark, sf_dir):
    return vectors.epsilon_join(table(spark, sf_dir, "embeddings"))


@query(vectors.TOP_K_ORACLE)
def op7_exact_top_k(spark, sf_dir):
    all_ = table(spark, sf_dir, "embeddings")
    return vectors.top_k(all_, all_.where(F.col("vec_id") % 50 == 0))


@query(urls.oracle())
def op10_url_template_tree(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).drop("purity")


@query(warc.ORACLE)
def op6_warc_source(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


@query()
def op2_kneser_ney_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


@query(lines.ORACLE)
def op9_log_template_lines(spark, sf_dir):
    return lines.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query()
def op4_license_alignment(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op8_variable_best_fit(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))
