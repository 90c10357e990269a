import datetime
import gzip

from pyspark.sql import functions as F

from certloom.operators import forms as O
from certloom.sources import files as S


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_feeds(spark, tmp_path):
    path = write(tmp_path / "feed", "a.csv", "url,submission_time,target\nhttp://A.example/x,2024-05-01T00:00:00,Bank\nhttp://b.example/,2023-01-01T00:00:00,\nhttp://c.example/,never,\nnone,2024-05-02T00:00:00,\nhttp://d.example/,2024-05-03T00:00:00,\n")
    rows = S.read_feed(spark, path, datetime.datetime(2024, 4, 1)).collect()
    assert sorted((r.host, r.target) for r in rows) == [("a.example", "Bank"), ("d.example", "")]
    urls = write(tmp_path / "urls", "1.txt", "https://A.example/x \n\nplain\n")
    write(tmp_path / "urls", "2.txt", "https://A.example/x\nhttp://b.example:80/\n")
    found = S.first_listed(S.read_urls(spark, urls)).collect()
    assert sorted((r.url, r.host) for r in found) == [("http://b.example:80/", "b.example"), ("https://A.example/x", "a.example")]
    stream = S.first_listed(S.read_urls(spark, urls, stream=True)).writeStream.format("memory").queryName("listed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r.host for r in spark.table("listed").collect()) == ["a.example", "b.example"]
    ranked = write(tmp_path / "rank", "r.csv", "1, Top.example\n2,next.example\n3,last.example\n")
    assert [tuple(r) for r in S.read_ranked(spark, ranked, 2).orderBy("rank").collect()] == [(1, "top.example"), (2, "next.example")]


def test_counters_and_log(spark, tmp_path):
    path = write(tmp_path / "c", "one.txt", '# HELP\ncertstreamservergo_certs_by_log_total{url="https://l.example/x/",operator="Op"} 12\nother 3\n')
    assert [(r.url, r.operator, r.n) for r in S.read_counters(spark, path).collect()] == [("https://l.example/x", "Op", 12)]
    lines = ["[23:40] start", "reconnecting after 3", "[00:10] openphish: 5 new", "[00:05] {\"n\": 1}", "openphish poll failed: x", "noise"]
    rows = spark.createDataFrame([("a", k, datetime.date(2024, 5, 1), v) for k, v in enumerate(lines)], "log string, line long, day0 date, value string")
    got = {r.line: (r.at, r.kind) for r in S.log_times(rows).collect()}
    start = got[0][0]
    assert got == {0: (start, "other"), 1: (None, "reconnect"), 2: (start + 1800, "poll"), 3: (start + 1500, "stats"), 4: (None, "poll_failed")}


def test_mails_and_export(spark, tmp_path):
    path = write(tmp_path / "m", "1.eml", "Subject: x\n\nhello")
    labels = spark.createDataFrame([("1.eml", "clean"), ("2.eml", "malicious")], "file string, label string")
    assert [(r.file, r.label) for r in S.read_mails(spark, path, labels).collect()] == [("1.eml", "clean")]
    assert S.export(spark.range(10), str(tmp_path / "out")) == 10
    assert sum(len(gzip.decompress(p.read_bytes()).splitlines()) - 1 for p in (tmp_path / "out").glob("*.gz")) == 10


def test_forms(spark):
    html = '<form action="/in" METHOD=post><input type="password"></form><form action="https://evil.test/p"><input name=p type=password></form><FORM><input name="x"><form action="b?x">'
    pages = spark.createDataFrame([(1, "https://www.a.example/d/i.html?q=1", html), (2, "https://b.example", None), (3, "https://c.example", "<form action=go><input type='password'>")], "page_id long, url string, html string")
    got = {(r.page_id, r.form): (r.action, r.method, r.has_password) for r in O.forms(pages).collect()}
    assert got == {
        (1, 0): ("https://www.a.example/in", "post", True),
        (1, 1): ("https://evil.test/p", "get", True),
        (1, 2): ("https://www.a.example/d/i.html?q=1", "get", False),
        (1, 3): ("https://www.a.example/d/b?x", "get", False),
        (3, 0): ("https://c.example/go", "get", True),
    }
    sites = spark.createDataFrame([("www.a.example", "a.example"), ("evil.test", "evil.test")], "host string, site string")
    own = spark.createDataFrame([(1, "a.example"), (3, "c.example")], "page_id long, site string")
    brands = lambda *s: spark.createDataFrame([(x,) for x in s], "site string")
    assert [tuple(r) for r in O.foreign_credential_posts(O.forms(pages), sites, own, brands("bank.example")).collect()] == [(1, 1, "evil.test")]
    assert O.foreign_credential_posts(O.forms(pages), sites, own, brands("evil.test")).count() == 0


def test_credentials_auth_and_bytes(spark):
    rows = spark.createDataFrame([("<input type='Password'>",), ('<input id="login-otp">',), ("<p>password otp</p>",), (None,)], "html string")
    assert [r[0] for r in rows.select(O.credential_input(F.col("html"))).collect()] == [True, True, False, False]
    rows = spark.createDataFrame([(["mx; spf=fail spf=pass dkim=none", "dkim=pass"], None), (["mx; dmarc=FAIL"], "Neutral (x)"), (None, None), ([], "pass")], "h array<string>, r string")
    got = [tuple(r[0]) for r in rows.select(O.auth_results(F.col("h"), F.col("r"))).collect()]
    assert got == [("pass", "none", "none"), ("neutral", "none", "fail"), ("absent", "absent", "absent"), ("pass", "absent", "absent")]
    rows = spark.createDataFrame([("1.5 MB",), ("7B",), ("2 kB / 3 GB",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(O.byte_count(F.col("t"))).collect()] == [1.5e6, 7.0, 2e3, None, None]


def test_ids_and_tokens(spark):
    nodes = spark.createDataFrame([("ip", "1"), ("ip", "1"), ("ns", "1")], "kind string, value string")
    ids = O.node_ids(nodes).collect()
    assert len(ids) == len({r.id for r in ids}) == 2
    brands = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["y"]), ("c", None)], "name string, tokens array<string>")
    assert [tuple(r) for r in O.duplicate_tokens(brands).collect()] == [("y", 2)]


def test_mails_of_folders(spark, tmp_path):
    """Mails written by tasks are dealt to folders and read back as they are; those without a label are not opened."""
    rows = [(f"m{k}.eml", f"From: {k}\r\n\r\né {k}") for k in range(50)]
    S.write_mails(spark.createDataFrame(rows, "file string, raw string").repartition(4, "file"), str(tmp_path / "m"))
    (tmp_path / "m" / "file=odd.eml").mkdir()
    (tmp_path / "m" / "file=odd.eml" / "part-0.txt").write_text("odd")
    (tmp_path / "m" / "_SUCCESS").write_text("")
    assert len(list((tmp_path / "m").glob("part-*"))) > 1
    labels = spark.createDataFrame([(f, k) for k, (f, _) in enumerate(rows[:40])] + [("odd.eml", 99), ("none.eml", 100)], "file string, label int")
    got = sorted((r.label, r.file, r.raw) for r in S.read_mails(spark, str(tmp_path / "m"), labels).collect())
    assert got == [(k, f, x) for k, (f, x) in enumerate(rows[:40])] + [(99, "odd.eml", "odd")]


def test_a_day_has_as_many_files_as_its_lines_ask_for(spark, monkeypatch):
    """One task reads a gzip file whole, so a day is not one file."""
    from certloom.sources import landed

    monkeypatch.setattr(landed, "LINES_A_FILE", 100)
    lines = spark.range(3000).selectExpr("id % 2 as day", "cast(id as string) as value")
    path = landed.land(lines, "days", "day")
    read = spark.read.text(path)
    assert len(read.inputFiles()) >= 16 and sorted((r.day, int(r.value)) for r in read.collect()) == sorted((k % 2, k) for k in range(3000))
