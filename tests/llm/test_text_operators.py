import random
import re
import time

import numpy as np

from octaframe.llm import licenses, lines, packing

SCHEMA = "doc_id long, text string, n_lines string"


def test_lines_recur_and_generalise(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    rows = [(i, f"unique {chr(97 + i)} line here\nPosted at {i} by the same old author team\nshared short line\n\n" + (passage if i in (1, 3) else "end " + chr(97 + i)), "x") for i in range(4)]
    rows += [(10, None, "x"), (11, "", "x"), (None, "shared short line\nown", "x"), (0, rows[0][1], "x")]
    got = lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].n_dropped == 0 and by[0].text == rows[0][1]
    assert by[1].text == f"unique b line here\n\n{passage}" and by[1].n_dropped == 2
    assert by[3].text == "unique d line here\n" and by[3].n_dropped == 3
    assert by[10].text is None and by[10].n_dropped == 0 and by[11].text == "" and by[None].text == "own"
    assert len(got) == len(rows)
    assert lines.drop_recurring(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_become_variable_in_a_leaf(spark):
    names = ["ada", "bob", "cleo", "dan", "eve", "fay", "gus", "hal"]
    rows = [(i, f"Written by our author {n} for the morning news desk", "x") for i, n in enumerate(names)]
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 8))


def test_rows_of_digits_recur_by_their_exact_text(spark):
    table = [f"{i} {40 + i} {7 * i}\n2024-01-0{i} score {i}:1 {i}" for i in range(1, 6)]
    logs = [f"{i} {i + 1} {i + 2} the red {w} went home" for i, w in enumerate(["ant", "bee", "cat", "dog", "elk"])]
    rows = [(i, f"{t}\n12 40  7\n{x}\nPosted at {i} by the same old author team", "x") for i, (t, x) in enumerate(zip(table, logs))]
    got = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert all(got[i].text == f"{table[i]}\n{logs[i]}" and got[i].n_dropped == 2 for i in range(1, 5))
    # masked, the constant tokens are 7 of 10; digits do not help two more variable ones over the share
    names = [f"{i} {i} {i} we met our friend {a} near {b}" for i, (a, b) in enumerate([("ada", "rome"), ("bob", "oslo"), ("cleo", "bern"), ("dan", "kyiv")])]
    got = lines.drop_recurring(spark.createDataFrame([(i, t, "x") for i, t in enumerate(names)], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(names))


def test_pack_is_valid_and_full(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 8193, 3000)
    bins, offsets, caps = packing.pack(sizes)
    fill = np.bincount(bins, weights=sizes).astype(int)
    cap = np.zeros(len(fill), int)
    cap[bins] = caps
    assert (fill <= cap).all() and set(cap) <= set(packing.CAPACITIES)
    smaller = [max([c for c in packing.CAPACITIES if c < x], default=0) for x in cap]
    assert (fill > np.array(smaller)).all()  # downsized
    spans = sorted(zip(bins, offsets, offsets + sizes))
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert fill.sum() / cap.sum() > 0.95


def brute_pack(sizes, caps):
    """Best fit by looking at every open bin."""
    bins = []
    left, where = sum(sizes), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fit = [b for b in bins if b[0] >= n]
        if fit:
            room = min(b[0] for b in fit)
            b = max((b for b in fit if b[0] == room), key=lambda b: b[2])  # the one touched last
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: (packing.cost(c) / min(c, left), -c))
            bins.append(b := [cap, len(bins), 0, 0])
        b[0] -= n
        b[3] += n
        b[2] = len(where)
        where[i] = b[1]
        left -= n
    return [where[i] for i in range(len(sizes))], [min(c for c in caps if c >= b[3]) for b in bins]


def test_pack_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(5):
        sizes = rng.integers(1, 600, 120)
        bins, _, caps = packing.pack(sizes, (64, 256, 600))
        want, final = brute_pack(sizes.tolist(), (64, 256, 600))
        assert bins.tolist() == want and caps.tolist() == [final[b] for b in want]


def test_packing_loses_nothing(spark):
    rows = [(i, "w " * n, "x") for i, n in enumerate([0, 1, 5, 8192, 8193, 20000, 300])] + [(None, "a b", "x"), (3, None, "x"), (1, "w", "x")]
    got = packing.best_fit(spark.createDataFrame(rows, SCHEMA)).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
        assert (r.bin_id is None) == (r.length == 0)
    assert words == {0: 0, 1: 2, 2: 5, 3: 8192, 4: 8193, 5: 20000, 6: 300, None: 2}
    assert packing.best_fit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_license_spans(spark):
    text = "İntro text.\nLicensed under the Apache License, version 2.0. More.\nReleased under  the MIT Licence-License"
    rows = [(1, text, "x"), (2, "nothing here", "x"), (3, None, "x"), (4, "", "x"), (None, "ALL RIGHTS RESERVED", "x")]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    one = sorted((r.start, r.license, r.coverage) for r in got if r.doc_id == 1)
    assert [x[1] for x in one] == ["Apache-2.0", "MIT"] and one[0][2] == 1.0
    assert text[one[0][0] :].startswith("Licensed under the Apache")
    assert {r.doc_id: r.license for r in got if r.doc_id != 1} == {2: None, 3: None, 4: None, None: "proprietary"}
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_alignment_with_edits():
    index = licenses.Index({"t": " ".join(f"w{k}" for k in range(40))})
    words = [f"w{k}" for k in range(40)]
    edited = ["pre"] * 7 + words[:10] + ["new"] + words[10:20] + words[22:] + ["post"] * 5
    ((name, coverage, matched, start, end),) = index.scan(" ".join(edited))
    assert (name, matched) == ("t", 38) and coverage == 0.95
    assert " ".join(edited)[start:end].split()[0] == "w0" and " ".join(edited)[start:end].endswith("w39")
    assert index.scan(" ".join(words[:25])) == []


def test_every_occurrence_is_reported():
    index = licenses.Index(licenses.TEMPLATES)
    spans = lambda text: [(m[0], m[3], m[4]) for m in index.scan(text)]
    assert spans("All rights reserved. All rights reserved.") == [("proprietary", 0, 19), ("proprietary", 21, 40)]
    assert [m[0] for m in index.scan("Released under an MIT License")] == ["MIT"]
    assert [m[0] for m in index.scan("This work is licensed under the GNU General Public License, version 2")] == ["GPL-2.0"]
    assert all([m[0] for m in index.scan(text)] == [name] for name, text in licenses.TEMPLATES.items())
    took = []
    for n in (5_000, 20_000):
        began = time.time()
        assert len(index.scan("Licensed under the Apache License, version 2.0! " * n)) == n
        took.append(time.time() - began)
    assert took[1] < 16 * took[0]  # four times the text; quadratic work would be beyond


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_scan_against_brute_force():
    """Planted notices, copied, repeated and edited: all are found where they are, and what is reported holds."""
    rng = random.Random(11)
    index = licenses.Index(licenses.TEMPLATES)
    tokens = lambda text: re.findall(r"\w+", text.lower())
    for _ in range(60):
        parts, planted = [], []
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.7:
                parts.append(" ".join(f"f{rng.randrange(50)}" for _ in range(rng.randrange(8, 30))))
            name = rng.choice(sorted(licenses.TEMPLATES))
            words = licenses.TEMPLATES[name].split()
            edits = 0 if len(words) < 8 else rng.randrange(1 + len(words) // 20)
            for k in rng.sample(range(2, len(words) - 2), edits) if edits else ():
                words[k] = f"edit{k}"
            at = sum(len(p) + 1 for p in parts)
            parts.append(" ".join(words))
            planted.append((name, at, at + len(parts[-1])))
        text = " ".join(parts)
        got = index.scan(text)
        assert all(a[4] <= b[3] for a, b in zip(got, got[1:]))
        for name, coverage, matched, start, end in got:
            want = tokens(licenses.TEMPLATES[name])
            assert matched <= common(want, tokens(text[start:end])) and coverage == matched / len(want) >= licenses.LEAST_COVERAGE
        for name, start, end in planted:
            over = [m for m in got if m[3] < end and m[4] > start]
            assert over, (name, text[start:end])
            own = len(tokens(licenses.TEMPLATES[name]))
            assert any(m[0] == name or m[2] >= LEAST * own for m in over), (name, over)


LEAST = 0.8


def test_license_names_may_clash(spark):
    docs = spark.createDataFrame([("All rights reserved", "a", 5)], "text string, license string, start int")
    got = licenses.scan(docs, id_col="license")
    assert got.columns == ["license", "license_", "coverage", "matched", "start", "end"] and got.first()[:2] == ("a", "proprietary")


def test_copies_of_a_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 1000)
    docs = spark.range(9000).selectExpr("1L as piece", "'a b c' as text", "id as bin_id")
    got = packing.best_fit(docs, id_col="piece")
    assert got.columns == ["piece", "piece_", "start", "length", "bin_id", "capacity", "offset"]
    rows = got.collect()
    shards = np.bincount([r.bin_id >> 32 for r in rows])
    assert len(rows) == 9000 and len(shards) > 5 and shards.max() < 4000
    assert sorted({(r.bin_id, r.offset) for r in rows}) == sorted((r.bin_id, r.offset) for r in rows)
