"""URL filter: explicit rules first, then a path-template tree with smoothed labelled purity.

Paths are collapsed to their segments, digits masked.  The tree is as deep as
the deepest path, but for MOST_DEPTH: what follows there counts as one segment.
Level by level below each host, a segment that is one of many and rare becomes
a wildcard.  Then siblings that differ in one segment alone, and whose labelled
shares of blocked pages do not differ statistically, are merged.  A template
is rejected when its share of blocked pages, smoothed by that of its host and
of all pages, is above a threshold.  Every step is an aggregation with map-side
sums and an equality join; the joins of pages have the segment in their key,
so that a giant host is spread out.  The steps are SQL, the same for any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: (host, path prefix without the leading slash, verdict)
RULES = (
    ("com", "en/", "block"),
    ("example.com", "en/7", "allow"),
    ("net", "de/", "allow"),
    ("example.net", "de/8", "block"),
    ("org", "es/", "block"),
)
#: A segment is variable if its parent has more children and it has a smaller share than these.
MANY, RARE = 8, 0.05
#: Squared normal quantile for "not different", the weight of the prior, and the share that rejects.
CHI, PRIOR, REJECT = 3.84, 4.0, 0.5
#: Levels below a host at most; a path's segments from there on are one.
MOST_DEPTH = 10


def _rule_sql(rules) -> tuple[str, str]:
    """CASE expressions for rule and verdict over columns host and path; longer rules first."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    whens = []
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = {q(host)} OR right(host, {len(host) + 1}) = {q('.' + host)}) AND left(path, {len(path) + 1}) = {q('/' + path)}"
        whens.append((fits, q(f"{host}/{path}"), q(verdict)))
    case = lambda n: "CASE " + " ".join(f"WHEN {w[0]} THEN {w[n]}" for w in whens) + " ELSE NULL END" if whens else "CAST(NULL AS STRING)"
    return case(1), case(2)


def _t(depth: int) -> list[str]:
    return [f"t{i}" for i in range(1, depth + 1)]


def _s(depth: int) -> list[str]:
    return [f"s{i}" for i in range(1, depth + 1)]


def _steps(depth: int) -> list[tuple[str, str]]:
    """Named queries from w0 (host, s1..., n, lab, blk) to the templates; names in braces are earlier results."""
    steps, t_all = [], _t(depth)
    s = ", ".join(f"w.{c}" for c in ["host", *_s(depth), "n", "lab", "blk"])
    for i in range(1, depth + 1):
        over = ["host", *t_all[: i - 1]]
        same = " AND ".join(f"k.{c} = q.{c}" for c in over)
        hit = " AND ".join(f"w.{c} = r.{c}" for c in [*over, f"s{i}"])
        cols = ", ".join(over)
        steps += [
            (f"k{i}", f"SELECT {cols}, s{i}, CAST(sum(n) AS BIGINT) AS c FROM {{w{i - 1}}} GROUP BY {cols}, s{i}"),
            (f"q{i}", f"SELECT {cols}, CAST(sum(c) AS BIGINT) AS c FROM {{k{i}}} GROUP BY {cols} HAVING count(*) > {MANY}"),
            (f"r{i}", f"SELECT {', '.join(f'k.{c}' for c in over)}, k.s{i} FROM {{k{i}}} k JOIN {{q{i}}} q ON {same} WHERE k.s{i} <> '' AND k.c < {RARE} * q.c"),
            (f"w{i}", f"SELECT {s}{''.join(f', w.{c}' for c in t_all[: i - 1])}, CASE WHEN r.host IS NULL THEN w.s{i} ELSE '*' END AS t{i} FROM {{w{i - 1}}} w LEFT JOIN {{r{i}}} r ON {hit}"),
        ]
    for i in range(1, depth + 1):
        at, now, cols = depth + i, t_all[i - 1], ["host", *t_all]
        rest = [c for c in cols if c != now]
        # (blk - lab * share)^2 against chi * lab * share * (1 - share), times the squared pooled count: integers alone.
        alike = (
            f"p.lab = 0 OR g.lab = 0 OR (CAST(g.blk AS DOUBLE) * p.lab - CAST(g.lab AS DOUBLE) * p.blk) * "
            f"(CAST(g.blk AS DOUBLE) * p.lab - CAST(g.lab AS DOUBLE) * p.blk) <= {CHI} * g.lab * p.blk * (CAST(p.lab AS DOUBLE) - p.blk)"
        )
        steps += [
            (f"g{i}", f"SELECT {', '.join(cols)}, CAST(sum(lab) AS BIGINT) AS lab, CAST(sum(blk) AS BIGINT) AS blk FROM {{w{at - 1}}} GROUP BY {', '.join(cols)}"),
            (f"p{i}", f"SELECT {', '.join(rest)}, CAST(sum(lab) AS BIGINT) AS lab, CAST(sum(blk) AS BIGINT) AS blk FROM {{g{i}}} WHERE {now} <> '' GROUP BY {', '.join(rest)} HAVING count(*) > 1"),
            (f"m{i}", f"SELECT {', '.join(f'g.{c}' for c in cols)} FROM {{g{i}}} g JOIN {{p{i}}} p ON {' AND '.join(f'g.{c} = p.{c}' for c in rest)} WHERE g.{now} <> '' AND ({alike})"),
            (f"w{at}", f"SELECT {s}, {', '.join(f'CASE WHEN m.host IS NULL THEN w.{c} ELSE {chr(39)}*{chr(39)} END AS {c}' if c == now else f'w.{c}' for c in t_all)} FROM {{w{at - 1}}} w LEFT JOIN {{m{i}}} m ON {' AND '.join(f'w.{c} = m.{c}' for c in cols)}"),
        ]
    return steps


def _purity(depth: int, lab: str, blk: str) -> str:
    """SQL for (host, s1..., template, purity); lab, blk: expressions for all labelled and all blocked pages."""
    cols, w = ["host", *_t(depth)], f"{{w{2 * depth}}}"
    listed = ", ".join(cols)
    template = "rtrim('/', concat(" + ", ".join(f"'/', w.{c}" for c in _t(depth)) + "))" if depth else "''"
    prior = f"((h.blk + {PRIOR} * (({blk} + {PRIOR / 2}) / ({lab} + {PRIOR}))) / (h.lab + {PRIOR}))"
    return (
        f"SELECT {', '.join(f'w.{c}' for c in ['host', *_s(depth)])}, {template} AS template, "
        f"(g.blk + {PRIOR} * {prior}) / (g.lab + {PRIOR}) AS purity FROM {w} w "
        f"JOIN (SELECT {listed}, sum(lab) AS lab, sum(blk) AS blk FROM {w} GROUP BY {listed}) g ON {' AND '.join(f'w.{c} = g.{c}' for c in cols)} "
        f"JOIN (SELECT host, sum(lab) AS lab, sum(blk) AS blk FROM {w} GROUP BY host) h ON w.host = h.host"
    )


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages.

    Labels of the tree are the verdicts of the rules (a bounded list).  A null url
    or one without :// has an empty host and path.  Urls of any length are taken
    whole; from the segment MOST_DEPTH on, a path's rest is one segment.  Repeated
    rows are judged alike and each counts as a page.  Of rules that fit the longest
    holds.  Where nothing is labelled every purity is one half, which does not
    reject; nor does a purity of exactly REJECT.  Other columns of pages are not
    looked at, whatever their names.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rule, verdict = _rule_sql(rules)
    seen = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), up, low).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    seen = seen.withColumns({"rule": F.expr(rule), "said": F.expr(verdict)})
    masked = F.split(F.regexp_replace("path", "[0-9]+", "0"), "/", -1)
    depth = min(MOST_DEPTH, max(1, (seen.agg(F.max(F.size(masked))).first()[0] or 0) - 1))
    part = lambda i: F.coalesce(F.try_element_at(masked, F.lit(i)), F.lit(""))
    rest = F.array_join(F.slice(masked, depth + 1, (1 << 31) - 1 - depth), "/")
    levels = _s(depth)
    seen = seen.withColumns({c: part(i + 2) if i < depth - 1 else rest for i, c in enumerate(levels)})
    leaves = seen.groupBy("host", *levels).agg(
        F.count("*").alias("n"),
        F.count("said").alias("lab"),
        F.count(F.when(F.col("said") == "block", 1)).alias("blk"),
    )
    made = {"w0": cut(leaves, "url-leaves")}
    for name, sql in _steps(depth):
        got = spark.sql(sql, **{k: v for k, v in made.items() if "{" + k + "}" in sql})
        made[name] = cut(got, f"url-{name}") if name[0] in "wg" else got
    lab, blk = made["w0"].agg(F.coalesce(F.sum("lab"), F.lit(0)), F.coalesce(F.sum("blk"), F.lit(0))).first()
    last = f"w{2 * depth}"
    purity = cut(spark.sql(_purity(depth, str(lab), str(blk)), **{last: made[last]}), "url-purity")
    on = [F.col(c) == F.col("m_" + c) for c in ("host", *levels)]
    told = purity.withColumnsRenamed({c: "m_" + c for c in ("host", *levels)})
    out = seen.join(broadcast_if_small(told, max_rows=500_000, max_bytes=64 << 20), on, "left")
    own = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def oracle() -> str:
    rule, verdict = _rule_sql(RULES)
    plain = lambda q: q.replace("{", "").replace("}", "")
    # DuckDB's rtrim has its arguments the other way round.
    steps = ", ".join(f"{n} AS MATERIALIZED ({plain(q)})" for n, q in _steps(MOST_DEPTH))
    purity = plain(_purity(MOST_DEPTH, "(SELECT lab FROM total)", "(SELECT blk FROM total)"))
    purity = purity.replace("rtrim('/', concat(", "rtrim(concat(").replace(")) AS template", "), '/') AS template")
    levels = _s(MOST_DEPTH)
    parts = ", ".join(f"coalesce(m[{i + 2}], '') AS {c}" for i, c in enumerate(levels[:-1]))
    return f"""
WITH x0 AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
x1 AS (SELECT *, {rule} AS rule, {verdict} AS said, string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/') AS m FROM x0),
x AS MATERIALIZED (SELECT *, {parts}, coalesce(array_to_string(m[{MOST_DEPTH + 1}:], '/'), '') AS {levels[-1]} FROM x1),
w0 AS MATERIALIZED (SELECT host, {', '.join(levels)}, count(*) AS n, count(said) AS lab, count(CASE WHEN said = 'block' THEN 1 END) AS blk FROM x GROUP BY ALL),
{steps}, total AS (SELECT sum(lab) AS lab, sum(blk) AS blk FROM w0), m AS ({purity})
SELECT x.page_id, x.host, x.path, x.rule, coalesce(x.said, CASE WHEN m.purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, m.template
FROM x LEFT JOIN m ON x.host = m.host AND {' AND '.join(f'x.{c} = m.{c}' for c in levels)}
"""
