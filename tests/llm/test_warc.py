import gzip
import hashlib

from octaframe.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip(spark):
    big = "é" * 60
    rows = [(5, "http://a/5", big, "x"), (2, "http://a/2", big, "x"), (9, None, big, None), (2, "http://a/2", big, "x"), (None, "http://a/n", big, "x")]
    rows += [(10, "http://a/10", "same", "x"), (11, "http://a/11", "same", "x"), (12, "http://a\r\n/12", None, "x"), (13, "u", "", "x"), (14, "u", "y" * 300_000, "x")]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, SCHEMA)).drop("target_uri").collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        b = (html or "").encode()
        again = html == big and i != 2
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def foreign(n=6):
    out = []
    for i in range(n):
        body = (b"payload %d " % i) * 2000
        kind = b"request" if i % 2 else b"response"
        out.append(b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://h/%d\r\nX-Folded: a\r\n b\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body + b"\r\n\r\n")
    return out


def test_foreign_files(spark, tmp_path):
    records = foreign()
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    for name in ("plain.warc", "members.warc.gz", "whole.warc.gz", ""):
        times = 1 if name else 3
        path = str(tmp_path / name)
        rows = warc.records(spark, path).collect()
        assert len(rows) == 6 * times and all(len(r.payload) == r.content_length for r in rows)
        assert rows[0].headers["X-Folded"] == "a b"
        wanted = warc.records(spark, path).where("record_type = 'request' and target_uri like 'http://h/3%'").collect()
        assert [r.target_uri for r in wanted] == ["http://h/3"] * times
        few = spark.read.format("warc").option("recordType", "response").load(path)
        assert few.count() == 3 * times


def test_unwanted_payloads_are_not_inflated(tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc._member(r) for r in foreign()))
    seen = []

    class Counted(warc._Gzip):
        def _more(self):
            seen.append(self.start)
            return super()._more()

    with open(path, "rb") as f:
        src = Counted(f, path.stat().st_size)
        n = 0
        while src.next_record():
            low, _ = warc._headers(src)
            src.end_record(int(low["content-length"]))
            n += 1
    assert n == 6 and len(seen) == 6


def test_predicates_are_pushed(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(foreign()))
    plan = warc.records(spark, str(tmp_path)).where("record_type = 'request'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")


def test_large_archives_are_read_in_ranges(spark, tmp_path):
    """Every record once, whatever the size of the ranges; and a payload that looks like members is none."""
    warc.register(spark)
    trap = bytearray(warc._member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n") * 50)
    rows = [(f"<urn:{i}>", "revisit" if i % 5 == 4 else "response", bytearray(hashlib.sha256(str(i).encode()).digest() * (i % 40))) for i in range(1500)]
    records = spark.createDataFrame([*rows, ("<urn:trap>", "resource", trap)], "record_id string, record_type string, payload binary").coalesce(1)
    for split in (1 << 30, 30_000, 997):
        path = str(tmp_path / str(split))
        records.write.format("warc").option("splitBytes", split).mode("append").save(path)
        df = spark.read.format("warc").load(path)
        assert {r.record_id: bytes(r.payload) for r in df.collect()} == {i: bytes(b) for i, _, b in rows} | {"<urn:trap>": bytes(trap)}
        assert df.count() == 1501 and (df.rdd.getNumPartitions() > 1) == (split < 1 << 30)
        revisits = spark.read.format("warc").load(path).where("record_type = 'revisit'").select("headers").collect()
        assert len(revisits) == 300 and all(r.headers["WARC-Profile"] == warc.REVISIT for r in revisits)
