"""Line dedup by a log-template tree of fixed depth.

A line is a sequence of tokens; tokens with digits are variable at once, if the
other tokens are most of the line.  A line of which they are not (a row of a
table, scores, dates) is in no leaf and is its own template, digits and all.
The tree has the token count on its first level and the leading tokens below; a
leaf is thus known from the line alone.  In a leaf with several different
lines, a token that few of them have at its position is variable too, if the
tokens that stay, those with digits not among them, are most of the line.  What
is left is the line's template.  Templates that recur across documents are
dropped, but for the document of smallest id that has them.

Texts are parsed once: the masked lines are stored, and read again only for
leaves with several.  Else lines travel as hashes.  Support is counted by (leaf,
position, token), never gathered by leaf, so a leaf of any size is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, positional

LEADING = 3
VARIABLE = "<*>"
WITH_DIGITS = "[^ ]*[0-9][^ ]*"
#: Different lines of a leaf that must share a token at a position for it to stay; share of tokens that must stay.
SUPPORT, STAY = 3, 0.7
#: Documents in which a template must recur: long lines, and others.
LONG_LINE, LONG_DOCS, OTHER_DOCS = 50, 2, 3


def _spaced(line: Column) -> Column:
    """Tokens joined by single spaces.  The costly pattern runs on the lines that need it."""
    odd = line.rlike(r"[\x09-\x0D]|\x20\x20")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _lined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that are not blank: id, text hash, position, masked line, its tokens, its hashes, leaf; lines mostly of digits are not masked and have no leaf."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_pos", "_line")
    )
    rows = rows.select("_id", "_th", "_pos", _spaced(F.col("_line")).alias("_m")).where("_m <> ''")
    length = F.length("_m") - F.length(F.replace("_m", F.lit(" "), F.lit(""))) + 1
    digits = F.when(F.col("_m").rlike("[0-9]"), F.regexp_count("_m", F.lit(WITH_DIGITS))).otherwise(0)
    rows = rows.select("_id", "_th", "_pos", "_m", length.alias("_len"), digits.alias("_digits"))
    most = F.col("_len") - F.col("_digits") >= STAY * F.col("_len")
    masked = F.when(most & (F.col("_digits") > 0), F.regexp_replace("_m", WITH_DIGITS, VARIABLE)).otherwise(F.col("_m"))
    rows = rows.select("_id", "_th", "_pos", masked.alias("_m"), "_len", most.alias("_most"))
    leaf = F.when(F.col("_most"), F.xxhash64("_len", F.substring_index("_m", " ", LEADING)))
    rows = rows.select("_id", "_th", "_pos", "_m", "_len", F.xxhash64("_m").alias("_h"), F.hash("_m").alias("_g"), leaf.alias("_leaf"))
    return rows.withColumn("_m", F.when(F.col("_leaf").isNotNull(), F.col("_m")))


def _templates(lines: DataFrame) -> DataFrame:
    """(_h, _g) of lines that a leaf generalises -> hashes of the template."""
    different = lines.where("_leaf is not null").select("_leaf", "_h", "_g").distinct()
    several = cut(different.groupBy("_leaf").agg(F.count("*").alias("_k")).where(F.col("_k") >= SUPPORT).select("_leaf"), "line-leaves")
    some = lines.join(broadcast_if_small(several.withColumnRenamed("_leaf", "_l2"), 1_000_000), F.col("_leaf") == F.col("_l2"), "left_semi")
    some = cut(some.select("_leaf", "_h", "_g", "_m").distinct(), "line-several")
    some = some.select("_leaf", "_h", "_g", F.split("_m", " ", -1).alias("_t"))
    spread = some.select("_leaf", "_h", "_g", F.posexplode("_t").alias("_p", "_w")).where(F.col("_w") != VARIABLE)
    support = spread.groupBy("_leaf", "_p", "_w").agg(F.count("*").alias("_n")).where(F.col("_n") >= SUPPORT)
    stays = spread.join(cut(support.select("_leaf", "_p", "_w"), "line-support"), ["_leaf", "_p", "_w"], "left_semi")
    kept = stays.groupBy("_leaf", "_h", "_g").agg(F.collect_set("_p").alias("_keep"))
    found = some.join(kept, ["_leaf", "_h", "_g"])
    more = F.size("_keep") < F.size(F.filter("_t", lambda t: t != VARIABLE))
    found = found.where((F.size("_keep") >= STAY * F.size("_t")) & more)
    template = F.array_join(F.transform("_t", lambda t, i: F.when(F.array_contains("_keep", i), t).otherwise(VARIABLE)), " ")
    return cut(found.select(F.col("_h").alias("_fh"), F.col("_g").alias("_fg"), F.xxhash64(template).alias("_xh"), F.hash(template).alias("_xg")), "line-templates")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with recurring lines taken out of text_col, and the columns n_lines and n_dropped.

    Lines end at a newline; blank lines stay and are no templates.  A template
    recurs if it is in LONG_DOCS different documents (lines of LONG_LINE tokens
    or more) or OTHER_DOCS (shorter ones).  Null and empty texts come back as
    they are, with 0 lines dropped.  Lines of any length are parsed whole; of
    documents with a recurring line the smallest id keeps it.  Rows of one id are
    one document.  Rows with
    a null id are no document of their own: they lose what recurs among others.
    Columns of docs named n_lines and n_dropped are replaced.  An empty table
    gives an empty result.
    """
    docs, names = positional(docs.drop("n_lines", "n_dropped"))
    id_col, text_col = names[id_col], names[text_col]
    lines = cut(_lined(docs, id_col, text_col), "line-lines")
    general = _templates(lines)
    named = lines.join(broadcast_if_small(general), (F.col("_h") == F.col("_fh")) & (F.col("_g") == F.col("_fg")), "left")
    named = named.select("_id", "_th", "_pos", "_len", F.coalesce("_xh", "_h").alias("_a"), F.coalesce("_xg", "_g").alias("_b"))
    by_doc = named.where("_id is not null").groupBy("_a", "_b", "_id").agg(F.max("_len").alias("_len"))
    seen = by_doc.groupBy("_a", "_b").agg(F.count("*").alias("_docs"), F.min("_id").alias("_first"), F.max("_len").alias("_len"))
    recurs = F.col("_docs") >= F.when(F.col("_len") >= LONG_LINE, LONG_DOCS).otherwise(OTHER_DOCS)
    recurring = cut(seen.where(recurs).select(F.col("_a").alias("_ra"), F.col("_b").alias("_rb"), "_first"), "line-recurring")
    gone = named.join(broadcast_if_small(recurring, 1_000_000, 32 << 20), (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb")))
    gone = gone.where(~F.col("_id").eqNullSafe(F.col("_first")))
    drops = gone.groupBy(F.col("_id").alias("_d"), F.col("_th").alias("_dh")).agg(F.collect_set("_pos").alias("_drop"))
    drops = cut(drops.withColumn("_key", F.xxhash64("_d", "_dh")), "line-drops")
    key = F.xxhash64(F.col(id_col), F.xxhash64(text_col))
    same = (key == F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_d")) & (F.xxhash64(text_col) == F.col("_dh"))
    out = docs.join(broadcast_if_small(drops, 1_000_000, 48 << 20), same, "left")
    parts = F.split(F.col(text_col), "\n", -1)
    text = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_drop", i)), "\n")
    out = out.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long"),
            "n_dropped": F.coalesce(F.size(F.coalesce("_drop", F.array().cast("array<int>"))), F.lit(0)).cast("long"),
            text_col: F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(text),
        }
    )
    return out.select(*(F.col(c).alias(n) for n, c in names.items()), "n_lines", "n_dropped")


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, p AS pos, list_transform(list_filter(regexp_split_to_array(ls[p], '[\x20\x09-\x0D]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{VARIABLE}' ELSE t END) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(p)),
k AS (SELECT doc_id, pos, t, array_to_string(t, ' ') AS h, concat_ws(chr(1), len(t), coalesce(t[1], ''), coalesce(t[2], ''), coalesce(t[3], '')) AS leaf FROM l WHERE len(t) > 0),
d AS (SELECT DISTINCT leaf, h, t FROM k),
w AS (SELECT leaf, h, t, p, t[p] AS tok FROM (SELECT * FROM d WHERE leaf IN (SELECT leaf FROM d GROUP BY leaf HAVING count(*) >= {SUPPORT})), unnest(range(1, len(t) + 1)) AS u(p)),
s AS (SELECT *, count(*) OVER (PARTITION BY leaf, p, tok) AS n FROM w),
g AS (SELECT h, string_agg(CASE WHEN n >= {SUPPORT} THEN tok ELSE '{VARIABLE}' END, ' ' ORDER BY p) AS x
  FROM s GROUP BY leaf, h HAVING count(*) FILTER (n >= {SUPPORT}) >= {STAY}::DOUBLE * count(*) AND count(*) FILTER (n >= {SUPPORT}) < count(*)),
m AS (SELECT k.doc_id, k.pos, len(k.t) AS len, coalesce(g.x, k.h) AS x FROM k LEFT JOIN g ON k.h = g.h),
r AS (SELECT x, min(doc_id) AS first FROM m GROUP BY x
  HAVING count(DISTINCT doc_id) >= CASE WHEN max(len) >= {LONG_LINE} THEN {LONG_DOCS} ELSE {OTHER_DOCS} END),
z AS (SELECT m.doc_id, list(m.pos) AS gone FROM m JOIN r ON m.x = r.x WHERE m.doc_id <> r.first GROUP BY m.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(z.gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN z.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(z.gone, i)), chr(10)) END AS text
FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id
"""
