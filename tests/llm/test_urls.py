import random

import duckdb

from octaframe.llm import urls

SCHEMA = "page_id long, url string, verdict string"


def judge(spark, pairs, **kw):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pairs)], SCHEMA)
    return {r.page_id: r for r in urls.judge(df, **kw).collect()}


def test_rules_hosts_and_paths(spark):
    got = judge(spark, [
        "http://A.COM/en/1?x", "https://example.com/en/7", "https://www.example.com/en/77#t", "http://notexample.com/en/7", "ftp://b.net/de/8",
        "http://x.example.net/de/8", "http://c.org/es/", "http://c.org/es", "no scheme", None, "", "http://h", "http://h?x/en/", "a://b://c/en/", "http://com/en/",
    ])
    assert [(got[i].host, got[i].path) for i in (0, 8, 9, 11, 12, 13)] == [("a.com", "/en/1"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b:", "//c/en/")]
    rules = [got[i].rule for i in range(8)]
    assert rules == ["com/en/", "example.com/en/7", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None]
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "allow", "block", "allow", "block", "block"]
    assert got[14].rule == "com/en/"


def test_templates_generalise_and_purity_decides(spark):
    rules = (("h.com", "bad/seen/", "block"), ("h.com", "good/seen/", "allow"))
    pages = [f"http://h.com/bad/seen/a{k}" for k in range(40)] + [f"http://h.com/good/seen/a{k}" for k in range(400)]
    pages += [f"http://h.com/bad/u{chr(97 + k % 26)}x{chr(97 + k // 26)}/a" for k in range(60)]
    got = judge(spark, pages, rules=rules)
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[i].verdict for i in range(40, 440)} == {"allow"}
    assert {got[i].template.split("/")[2] for i in range(440, 500)} == {"*"}


def test_merge_keeps_different_branches_apart(spark):
    rules = (("h.com", "bad/", "block"), ("h.com", "good/", "allow"), ("h.com", "fine/", "allow"))
    pages = [f"http://h.com/{a}/page/{k}" for a in ("bad", "good", "fine") for k in range(50)]
    got = judge(spark, pages, rules=rules)
    assert {r.template.split("/")[1] for r in got.values()} != {"*"}


def test_empty(spark):
    assert judge(spark, []) == {}


def test_segments_below_the_third_generalise_too(spark):
    rules = (("h.com", "bad/", "block"), ("h.com", "good/", "allow"))
    pages = [f"http://h.com/{a}/b/c/d/u{chr(97 + k % 26)}x{chr(97 + k // 26)}/end/x" for a in ("bad", "good", "new") for k in range(60)]
    got = judge(spark, pages, rules=rules)
    assert {r.template.split("/")[5] for r in got.values()} == {"*"} and {r.template.split("/")[6] for r in got.values()} == {"end"}
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in range(60, 120)} == {"allow"}


def test_deep_paths_against_sql(spark):
    """Paths of up to 14 segments, in DuckDB by the same steps with a fixed depth."""
    rng = random.Random(6)
    hosts = ["a.com", "x.example.com", "b.net", "c.org", "d.io"]
    urls_ = [None, "", "no scheme"]
    for _ in range(3000):
        n = rng.choice([0, 1, 2, 3, 5, 8, 14])
        path = "/".join(rng.choice(["en", "de", "es", "a", "b", f"i{rng.randrange(60)}", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(n))
        urls_.append(f"http://{rng.choice(hosts)}/{path}{rng.choice(['', '/', '?q', '#f'])}")
    urls_ += ["http://a.com/" + "z/" * 3000, "http://a.com//x//y"]
    rows = [(i, u, "x", "mine") for i, u in enumerate(urls_)] + [(5, urls_[5], "x", "mine")] * 3 + [(None, urls_[9], None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", s1 string")
    con = duckdb.connect()
    con.register("rows", docs.toArrow())
    con.sql("CREATE TABLE pages AS SELECT * FROM rows")
    got = urls.judge(docs)
    want = con.sql(urls.oracle())
    key = lambda rs: sorted((tuple(r) for r in rs), key=str)
    assert key(got.select(*want.columns).collect()) == key(want.fetchall())
