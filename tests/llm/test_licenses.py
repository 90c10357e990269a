import random
import re

import pytest
from pyspark.sql import functions as F

from certloom.llm import licenses as L


def brute(rows):
    """Best containment by any window of three passage lengths, over all positions."""
    found = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for _, name, p in L.passages():
            s = {tuple(p[k : k + 5]) for k in range(len(p) - 4)}
            if len(s & have) / len(s) >= 0.8:
                found[i, name] = max(found.get((i, name), 0), len(s & have) / len(s))
    return found


def test_planted_notices(spark):
    rng = random.Random(3)
    junk = lambda n: " ".join(rng.choice("onn the ther and ble ting sh er re").lower() + str(rng.randrange(50)) for _ in range(n))
    rows = []
    for k, (_, text) in enumerate(L.TEMPLATES * 3):
        w = text.split()
        if k >= len(L.TEMPLATES) and len(w) > 30:
            w[len(w) // 2] = "changed"
        if k >= 2 * len(L.TEMPLATES):
            w = [x.upper() for x in w]
        rows.append((k, junk(rng.randrange(300)) + "\n" + " ".join(w) + ".\n" + junk(rng.randrange(200))))
    rows += [(900, None), (901, ""), (902, "license " * 500), (903, "MIT License"), (904, junk(3000)), (None, "Released under the MIT License."), (3, rows[3][1]), (905, "x Licensed under CC BY-NC 4.0. " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("words", F.lit(1))
    got = {(r.doc_id, r.license): r.containment for r in L.scan_licenses(df).collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert {(r.doc_id, r.license) for r in L.scan_licenses(d).collect()} == set(brute(rows))


def test_every_passage(spark):
    """Beginnings, middles and ends of whole templates, not of the passages the module keeps."""
    L.check_templates()
    with pytest.raises(ValueError):
        L.check_templates([("X", "Licensed under X. " + "some words that hold nothing of note here " * 12)])
    rows, want = [], set()
    for name, text in L.TEMPLATES:
        w = re.findall("[A-Za-z0-9]+", text)
        for at in range(0, max(1, len(w) - 24), 24):
            rows.append((len(rows), "xx yy zz " * 30 + " ".join(w[at : at + 48]) + " xx yy zz" * 30))
            want.add((rows[-1][0], name))
    grant = L.TEMPLATES[2][1].split()
    for n in (40, 50, 60, 79):
        rows.append((len(rows), " ".join(grant[:n])))
        want.add((rows[-1][0], "MIT"))
    got = {(r.doc_id, r.license) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got


def test_best_of_near_equal_templates(spark):
    notice = "This work is licensed under the GNU General Public License, version {}."
    lesser = "This library is free software: " + dict(L.TEMPLATES)["LGPL-3.0"]
    far = " ".join(f"w{i}" for i in range(400))
    rows = [(1, notice.format(3)), (2, notice.format(2)), (3, f"{notice.format(2)} {notice.format(3)}"), (4, f"{notice.format(3)} {far} {notice.format(2)}"), (5, lesser), (6, L.TEMPLATES[7][1]), (None, notice.format(3)), (7, " ".join([notice.format(3)] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in L.scan_licenses(df, best_only=True).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {1: {"GPL-3.0"}, 2: {"GPL-2.0"}, 3: {"GPL-2.0", "GPL-3.0"}, 4: {"GPL-2.0", "GPL-3.0"}, 5: {"LGPL-3.0"}, 6: {"GPL-3.0"}, None: {"GPL-3.0"}, 7: {"GPL-3.0"}}
    every = {(r.doc_id, r.license) for r in L.scan_licenses(df).collect()}
    assert {(1, "GPL-2.0"), (2, "GPL-3.0"), (5, "GPL-3.0")} <= every


def test_query_keeps_the_best(spark):
    found = L.op5_licenses(spark, "/root/testdata/sf0.01")
    assert found.filter("license = 'GPL-3.0'").count() and not found.filter("license = 'GPL-2.0'").count()


def test_first_word_is_where_the_notice_starts(spark):
    grant = L.TEMPLATES[2][1]
    rows = [(1, "xx " * 100 + L.TEMPLATES[7][1]), (2, "Released under the MIT License."), (3, "yy " * 37 + grant + " zz" * 9), (4, "license " * 60 + "xx " * 50 + L.TEMPLATES[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): r.first_word for r in L.scan_licenses(df, best_only=True).collect()}
    assert got == {(1, "GPL-3.0"): 100, (2, "MIT"): 0, (3, "MIT"): 37, (4, "GPL-3.0"): 110}
