"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Sources share a word budget by weight, none above ``max_repeat`` times its own
size.  Within a source every document gets an expected number of copies that
rises with the length class of the document.  Its whole part is allocated for
certain; for the fraction p, documents are ranked by random odds over
inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until
the rest of the source's words is reached: a sample of fixed size in words.

No sort runs over a source.  Ranks are bucketed, bucket sums find the one
bucket in which the cut falls, and only this bucket is ordered.  The result is
one cut per source, so that documents are decided where they stand.  Sources
themselves may be many, such as one for each site: what runs over all of them in
an order runs over ranges of that order, and then over the sums of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, positional, word_count

RANK_BUCKETS = 4096
#: Sources of a range of their order, about.
RANGE = 50_000


def waterfill(df: DataFrame, part: list[str], tie: str, weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Share ``total`` by ``weight`` within ``part``, nobody above ``cap``; the excess goes to the others by weight.

    In the order in which shares reach their caps, the level that is left for the
    rest rises as long as caps are reached and falls afterwards: its peak is the
    common level.
    """
    q = F.col(cap) / F.col(weight)
    before = Window.partitionBy(*part).orderBy(q, F.col(tie).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    used = F.coalesce(F.sum(cap).over(before), F.lit(0))
    gone = F.coalesce(F.sum(weight).over(before), F.lit(0))
    df = df.withColumn("_level", (F.col(total) - used) / (F.sum(weight).over(whole) - gone))
    df = df.withColumn("_level", F.max("_level").over(whole))
    return df.withColumn(out, F.least(F.col(cap), F.col("_level") * F.col(weight))).drop("_level")


def _running(df: DataFrame, order: list, sums: dict[str, Column], parts: int, name: str) -> DataFrame:
    """Add for each of ``sums`` its total over the rows before, in an order that tells all rows apart."""
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, name)
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    totals = ranged.groupBy(F.col("_part").alias("_p")).agg(*(F.sum(c).alias(f"_{n}_all") for n, c in sums.items()))
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    totals = totals.select("_p", *(F.coalesce(F.sum(f"_{n}_all").over(whole), F.lit(0)).alias(f"_{n}_before") for n in sums))
    out = out.join(F.broadcast(cut(totals, name + "-ranges")), F.col("_part") == F.col("_p"))
    return out.withColumns({n: F.col(n) + F.col(f"_{n}_before") for n in sums}).drop("_part", "_p", *(f"_{n}_before" for n in sums))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Add to each row of docs its copies in the mix.

    Added columns: mix_size (words), mix_source_size, mix_target (of the source,
    in words), mix_copies (0 to max_repeat), mix_taken (words taken).  Columns of
    docs with these names are replaced.

    Null texts and texts without words have size 0 and no copies.  A null source
    is a source of its own, the last.  Rows that agree in source, id and size
    are taken or left together.  A null id counts as the empty string.  Texts of
    any length count whole.  Ties of ranks go to the smaller id, then size.
    Other columns stay, whatever their names.  An empty table gives an empty
    result.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    docs, names = positional(docs.drop(*made))
    id_col, text_col, source_col = names[id_col], names[text_col], names[source_col]
    sized = cut(
        docs.select(
            F.col(source_col).alias("_s"),
            F.col(id_col).alias("_id"),
            word_count(F.col(text_col)).alias("_n"),
        ),
        "mix-sizes",
    )
    bits = F.when(F.col("_n") > 0, F.length(F.bin("_n"))).otherwise(0)
    sized = sized.withColumn("_b", bits)
    classes = sized.groupBy("_s", "_b").agg(F.sum("_n").alias("_a"))

    sources = cut(classes.groupBy("_s").agg(F.sum("_a").alias("mix_source_size")), "mix-sizes-of-sources")
    n_sources, size = sources.agg(F.count("*"), F.coalesce(F.sum("mix_source_size"), F.lit(0))).first()
    parts = max(1, -(-n_sources // RANGE))
    by_name = F.col("_s").asc_nulls_last()
    sources = _running(sources, [by_name], {"_turn": F.lit(1)}, parts, "mix-turns")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_w", weight).withColumn("_cap", F.col("mix_source_size") * max_repeat)
    sources = sources.withColumn("_q", F.col("_cap") / F.col("_w"))
    # In the order in which shares reach their caps, as in waterfill.
    sources = _running(sources, [F.col("_q").asc(), by_name], {"_used": F.col("_cap"), "_gone": F.col("_w")}, parts, "mix-levels")
    sources = cut(sources, "mix-filled")
    all_weights = sources.agg(F.sum("_w")).first()[0] or 0
    level = sources.agg(F.max((F.lit(float(share * size)) - F.col("_used")) / (F.lit(all_weights) - F.col("_gone")))).first()[0] or 0.0
    target = F.least(F.col("_cap"), F.lit(float(level)) * F.col("_w"))
    sources = cut(sources.select("_s", "mix_source_size", target.alias("mix_target")), "mix-sources")

    # Expected copies by length class: longer classes somewhat more often.
    rates = classes.where("_a > 0").join(sources.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    rates = rates.withColumn("_w", (1 + F.col("_b") / F.lit(8.0)) * F.col("_a")).withColumn("_cap", F.col("_a") * float(max_repeat))
    rates = waterfill(rates, ["_s"], "_b", "_w", "_cap", "mix_target", "_m")
    rates = rates.withColumn("_m", F.col("_m") / F.col("_a"))
    rates = rates.withColumn("_whole", F.floor("_m")).withColumn("_p", F.col("_m") - F.col("_whole"))
    rates = rates.withColumn("_rest", F.sum(F.col("_p") * F.col("_a")).over(Window.partitionBy("_s")))
    rates = cut(rates.select("_s", "_b", "_whole", "_p", "_rest"), "mix-rates")

    rank = (uniform(F.col("_id"), seed) / (1 - uniform(F.col("_id"), seed))) / _odds(F.col("_p"))
    on = F.col("_s").eqNullSafe(F.col("_rs")) & (F.col("_b") == F.col("_rb"))
    keyed = rates.withColumnsRenamed({"_s": "_rs", "_b": "_rb"})
    ranked = sized.where("_n > 0").join(broadcast_if_small(keyed), on).where("_p > 0")
    ranked = ranked.select("_s", "_id", "_n", "_rest", rank.alias("_q"))
    ranked = ranked.withColumn("_k", F.floor(RANK_BUCKETS * (F.col("_q") / (1 + F.col("_q")))))
    sums = ranked.groupBy("_s", "_k").agg(F.sum("_n").alias("_kn"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("_s").orderBy("_k")
    sums = sums.withColumn("_base", F.sum("_kn").over(upto) - F.col("_kn"))
    edge = cut(sums.where("_base <= _rest and _rest < _base + _kn").select("_s", "_k", "_base"), "mix-edges")
    edges = edge.withColumnsRenamed({"_s": "_es", "_k": "_ek"})
    inside = ranked.join(
        broadcast_if_small(edges), F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_k") == F.col("_ek"))
    )
    units = inside.groupBy("_s", "_q", "_id", "_n").agg(
        F.sum("_n").alias("_u"), F.first("_base").alias("_base"), F.first("_rest").alias("_rest")
    )
    order = Window.partitionBy("_s").orderBy("_q", F.col("_id").asc_nulls_first(), "_n")
    units = units.withColumn("_before", F.col("_base") + F.sum("_u").over(order) - F.col("_u"))
    taken = units.where(2 * F.col("_before") + F.col("_u") <= 2 * F.col("_rest"))
    last = F.max(F.struct("_q", "_id", "_n")).alias("_cut")
    cuts = edge.join(
        taken.groupBy(F.col("_s").alias("_ts")).agg(last), F.col("_s").eqNullSafe(F.col("_ts")), "left"
    ).select(F.col("_s").alias("_cs"), F.col("_k").alias("_ck"), "_cut")
    plan = sources.withColumnRenamed("_s", "_ss")
    plan = plan.join(keyed, F.col("_ss").eqNullSafe(F.col("_rs")), "left").drop("_rs")
    plan = plan.join(cuts, F.col("_ss").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    plan = cut(plan.select("_ss", "_rb", "mix_source_size", "mix_target", "_whole", "_p", "_ck", "_cut"), "mix-plan")
    totals = sources.withColumnRenamed("_s", "_ts")

    out = docs.withColumn("mix_size", word_count(F.col(text_col)))
    out = out.withColumn("_b", F.when(F.col("mix_size") > 0, F.length(F.bin("mix_size"))).otherwise(0))
    some = plan.where("_rb is not null").drop("mix_source_size", "mix_target")
    out = out.join(broadcast_if_small(totals), F.col(source_col).eqNullSafe(F.col("_ts")), "left")
    out = out.join(broadcast_if_small(some), F.col(source_col).eqNullSafe(F.col("_ss")) & (F.col("_b") == F.col("_rb")), "left")
    u = uniform(F.col(id_col), seed)
    q = (u / (1 - u)) / _odds(F.col("_p"))
    out = out.withColumn("_q", F.when(F.col("_p") > 0, q))
    k = F.floor(RANK_BUCKETS * (F.col("_q") / (1 + F.col("_q"))))
    here = F.struct(F.col("_q"), F.col(id_col).alias("_id"), F.col("mix_size").alias("_n"))
    drawn = F.col("_q").isNotNull() & (
        F.col("_ck").isNull() | (k < F.col("_ck")) | ((k == F.col("_ck")) & F.coalesce(here <= F.col("_cut"), F.lit(False)))
    )
    copies = F.when(F.col("mix_size") > 0, F.col("_whole") + drawn.cast("int")).otherwise(0)
    out = out.withColumn("mix_copies", copies.cast("int"))
    out = out.withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
    return out.select(*(F.col(c).alias(n) for n, c in names.items()), *made)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
b AS (
  SELECT *, CASE WHEN n > 0 THEN length(bin(n)) ELSE 0 END AS b,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/7'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d),
s0 AS (SELECT source, CAST(sum(n) AS DOUBLE) AS sz FROM b GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, sz * 2 AS cap,
  1.5::DOUBLE * sum(sz) OVER () AS t FROM s0),
s2 AS (SELECT *, (t - coalesce(sum(cap) OVER bef, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER bef, 0)) AS l
  FROM s1 WINDOW bef AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(l) OVER () AS lv FROM s2),
s AS (SELECT source, sz, least(cap, lv * w) AS target FROM s3),
c0 AS (SELECT source, b, CAST(sum(n) AS DOUBLE) AS a FROM b GROUP BY source, b HAVING sum(n) > 0),
c1 AS (SELECT c0.*, s.target, (1 + c0.b / 8.0::DOUBLE) * a AS w, a * 2 AS cap FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, (target - coalesce(sum(cap) OVER bef, 0)) / (sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER bef, 0)) AS l
  FROM c1 WINDOW bef AS (PARTITION BY source ORDER BY cap / w, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c3 AS (SELECT *, max(l) OVER (PARTITION BY source) AS lv FROM c2),
c4 AS (SELECT source, b, a, least(cap, lv * w) / a AS m FROM c3),
c AS (SELECT *, floor(m) AS whole, m - floor(m) AS p, sum((m - floor(m)) * a) OVER (PARTITION BY source) AS rest FROM c4),
r AS (SELECT b.*, c.whole, c.p, c.rest, CASE WHEN c.p > 0 THEN (u / (1 - u)) / (c.p / (1 - c.p)) END AS q
  FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.b = c.b),
k AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN n END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, n) AS upto,
  sum(n) OVER (PARTITION BY source, q, doc_id, n) AS unit FROM r)
SELECT k.doc_id, k.n AS size, CAST(s.sz AS BIGINT) AS source_size, s.target,
  CAST(CASE WHEN k.n = 0 THEN 0 ELSE k.n * (k.whole + CASE WHEN q IS NOT NULL AND 2 * (upto - unit) + unit <= 2 * rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source
"""
