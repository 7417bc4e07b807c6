"""A corpus pipeline of five stages, each an operator of octaframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  Within a stage the
columns of docs have names of the stage's own, so that no column of a user can
be mistaken for one of an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octaframe.llm import lines, minhash, mixing, packing, toxicity
from octaframe.llm.common import broadcast_if_small, cut, new_path, positional, scratch, table, word_count


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the user alone, with their names."""
    return df.select(*(F.col(c).alias(n) for n, c in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts get the score of no evidence, and stay if that is below
    one half.  Rows of one id are judged by their own texts; repeated rows are
    judged alike; a score of exactly one half rejects.  Texts of any length are
    judged whole.  A null id takes part, but has no label.  An empty table gives
    an empty one.  Other columns stay as they are.
    """
    docs, names = positional(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(names["doc_id"]), "toxic")
    scored = toxicity.score(docs, labels, names["doc_id"], names["text"])
    return _named(scored.where("predicted = 0"), names)


def _with_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with a column _same: the id, or the smallest id of those with the same text."""
    mark = F.md5(F.col(text_col).cast("binary"))
    copies = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(mark.alias("_mark"))
    copies = copies.agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_most")).where("_least < _most")
    few = broadcast_if_small(cut(copies.select("_mark", "_least"), "pipeline-copies"), 1_000_000, 64 << 20)
    marked = docs.join(few, mark == F.col("_mark"), "left")
    same = F.when(F.col(id_col).isNotNull(), F.coalesce("_least", id_col))
    return marked.withColumn("_same", same).drop("_mark", "_least")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that consisted of nothing else go.

    Copies of a text are one document here: what recurs only among them is no
    recurring line, and they keep and lose the same lines, so that they are still
    copies for the stage that drops copies.

    Null and empty texts stay as they are.  Rows of one id are one document, so
    lines that recur only among them stay; rows of a null id lose what recurs
    among others.  Of equal lines those of the smallest id stay.  n_chars, where
    there is such a column, follows the text of rows that lost lines.  Other
    columns stay as they are.  An empty table gives an empty one.
    """
    docs, names = positional(docs)
    out = lines.drop_recurring(_with_copies(docs, names["doc_id"], names["text"]), "_same", names["text"])
    out = out.where((F.col("n_dropped") == 0) | (word_count(F.col(names["text"])) > 0))
    if "n_chars" in names:
        kind = dict(docs.dtypes)[names["n_chars"]]
        length = F.when(F.col("n_dropped") > 0, F.length(names["text"]).cast(kind)).otherwise(F.col(names["n_chars"]))
        out = out.withColumn(names["n_chars"], length)
    return _named(out, names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with a column _key that tells documents apart: the id, but for null ids and ids with several texts, where it is a hash of both.

    Hashes keep clear of all ids.
    """
    number = F.col(id_col).try_cast("long")
    told = docs.select(number.alias("_i"), F.xxhash64(text_col).alias("_t")).groupBy("_i")
    odd = cut(told.agg(F.min("_t").alias("a"), F.max("_t").alias("b")).where("_i is null or a <> b").select("_i"), "pipeline-several")
    if odd.isEmpty():
        return docs.withColumn("_key", number)
    few = broadcast_if_small(odd.where("_i is not null").withColumnRenamed("_i", "_o"), 2_000_000, 32 << 20)
    marked = docs.join(few, number == F.col("_o"), "left")
    for salt in range(100):
        hashed = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.col(text_col), F.lit(salt))
        several = F.col("_o").isNotNull() | number.isNull()
        out = marked.withColumn("_key", F.when(several, hashed).otherwise(number))
        taken = out.where(several).select("_key").distinct()
        if taken.join(docs.select(number.alias("_i")), F.col("_key") == F.col("_i"), "left_semi").isEmpty():
            return out.drop("_o")
    raise RuntimeError("no hash that keeps clear of the ids")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest id.

    Different texts under one id, and texts without an id, are documents of
    their own; in a group with one of these any document may be the one that
    stays.  Of repeated rows of one document one stays, that of the smallest
    hash where other columns differ.  Documents whose texts are null, empty or
    without words are in no group.  Whole texts of any length are compared.  An
    empty table gives an empty one.  Other columns stay as they are.
    """
    docs, names = positional(docs)
    keyed = _keyed(docs, names["doc_id"], names["text"])
    found = cut(minhash.near_duplicates(keyed, "_key", names["text"]), "pipeline-groups")
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "pipeline-gone")
    left = keyed.join(broadcast_if_small(gone, 2_000_000, 32 << 20), F.col("_key") == F.col("_gone"), "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = cut(twice.select(F.col("doc_id").alias("_twice")), "pipeline-repeated")
    if twice.isEmpty():
        return _named(left, names)
    repeated = F.col("_key") == F.col("_twice")
    few = broadcast_if_small(twice, 2_000_000, 32 << 20)
    columns = list(names.values())
    one = left.join(few, repeated, "left_semi").groupBy("_key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return _named(left.join(few, repeated, "left_anti").select(*columns).union(one.select(*(F.col("_row")[c].alias(c) for c in columns))), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no size and are not taken.  A null source is one of
    its own, a null id counts as the empty string, and rows that agree in source,
    id and size are taken or left together.  An empty table gives an empty one.
    Other columns stay as they are.
    """
    docs, names = positional(docs)
    mixed = mixing.mix(docs, names["doc_id"], names["text"], names["source"]).where("mix_copies > 0")
    return _named(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the permitted lengths; see best_fit for nulls, empty texts, repeated rows and ties."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("near dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the language model nor greedy packing can be said in SQL; the tests hold each stage against SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage stored on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), name, path)
    return docs
