"""Raw messages and enrichment records in odd forms."""

import datetime

from pyspark.sql import functions as F

from certloom.operators import enrichment as E, letters as L


def test_parsed_mail(spark):
    raw = (
        "Received: from b.net (b.net [2001:db8::1]) by c.net; Tue, 7 Oct 2025 08:00:00 +0530\r\n"
        'received: from a.net by b.net;\r\n\tMon, 6 Oct 2025 23:59:59 +0000\r\nFrom: "Some ""Bank\""  <Care@Mail.Bank.COM.>\r\nReturn-Path: <>\r\nMESSAGE-ID: <x@id.org>\r\n\r\n'
        "one https://A.com/x, two http://u@b.org:8080/y?z=1! three https://A.com/x and From: fake@z.net"
    )
    df = spark.createDataFrame([(1, raw), (2, None), (3, ""), (4, "no headers at all"), (5, "From: plain@x.org\n\nhi\n\nhttps://x.org.")], "id int, raw string")
    r = {x.id: x for x in L.parsed(df, "raw", "id").collect()}
    assert (r[1].sender, r[1].reply, r[1].back, r[1].message) == ("mail.bank.com", None, None, "id.org") and r[1].display == "Some Bank"
    assert [(h.from_host, h.by_host, h.ip) for h in r[1].hops] == [("a.net", "b.net", None), ("b.net", "c.net", "2001:db8::1")]
    assert r[1].hops[1]["at"] - r[1].hops[0]["at"] == datetime.timedelta(hours=2, minutes=30, seconds=1)
    assert r[1].links == ["https://A.com/x", "http://u@b.org:8080/y?z=1"] and r[1].link_hosts == ["a.com", "b.org"]
    assert r[1].absent == ["Reply-To", "Authentication-Results", "DKIM-Signature"]
    assert all(r[k].absent == list(L.TRACKED) and r[k].links == [] and r[k].sender is None for k in (2, 3, 4))
    assert r[5].sender == "x.org" and r[5].links == ["https://x.org"] and r[5].auth.spf == "absent"


def test_claimed_brand(spark):
    brands = {"incometax": "Income Tax Dept", "vi": "Vodafone", "hdfc": "HDFC Bank"}
    said = {"Income Tax Department": "Income Tax Dept", "Service desk": None, "vi care": "Vodafone", "H.D.F.C. alerts": "HDFC Bank", "": None}
    df = spark.createDataFrame(list(said.items()), "display string, want string")
    assert all(x.got == x.want for x in df.withColumn("got", L.claimed_brand(F.col("display"), brands)).collect())


def test_addresses_networks_and_servers(spark):
    public = {"8.8.8.8": True, "10.1.2.3": False, "2606:4700::1111": True, "fe80::1": False, "::1": False, "ff02::1": False, "300.1.1.1": False, "": False, "name": False}
    got = spark.createDataFrame([*public.items(), (None, False)], "ip string, want boolean").withColumn("got", E.public_address(F.col("ip"))).collect()
    assert all(x.got == x.want for x in got)
    shared = {"ada.ns.cloudflare.com.": True, "NS-12.awsdns-33.co.uk": True, "ns1.notcloudflare.com": False, "ns1.own.net": False}
    assert all(x.got == x.want for x in spark.createDataFrame(list(shared.items()), "ns string, want boolean").withColumn("got", E.shared_dns(F.col("ns"))).collect())
    r = spark.createDataFrame([('"13335 14 | 1.0.0.0/24 | AU | apnic"',), ("junk",), (None,)], "t string").select(E.network(F.col("t")).alias("n")).collect()
    assert (r[0].n.asn, r[0].n.prefix, r[0].n.country) == (13335, "1.0.0.0/24", "AU") and r[1].n.asn is None and r[2].n.asn is None
    o = spark.createDataFrame([("HTTPS://u:p@Ex.com:8443/a?b",), ("ftp://x",), ("x",), (None,)], "u string").select(E.origin(F.col("u")).alias("o")).collect()
    assert [x.o for x in o] == ["https://ex.com:8443", "ftp://x", None, None]


def test_edges_of_odd_records(spark):
    df = spark.createDataFrame([(1, None, None, None, None, "", None, None), (2, ["1.1.1.1"], ["a.net", "a.net"], 13335, "CA", None, "k", "f")], "id int, ip_addresses array<string>, nameservers array<string>, asn long, cert_issuer string, registrar string, kit_hash string, favicon_hash string")
    got = {(r.id, r.kind, r.value, r.weight) for r in E.edges_of(df, "id").collect()}
    assert got == {(2, "nameserver", "a.net", 0.6), (2, "cert_issuer", "CA", 0.15), (2, "kit_hash", "k", 1.0), (2, "favicon_hash", "f", 0.85)}


def test_encoded_mails(spark):
    from base64 import b64encode

    from certloom.operators import letters

    b64 = lambda x, c="utf-8": b64encode(x.encode(c)).decode()
    html = '<a href="https://evil.example.com/pay">x</a>'
    mails = {
        "base64": f"From: =?utf-8?B?{b64('State Bänk')}?= <a@b.com>\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{b64(html)}",
        "quoted": "From: =?iso-8859-1?Q?State_B=E4nk?= <a@b.com>\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nsee https://evil.exam=\r\nple.com/pay?a=3D1",
        "nested": 'From: "=?utf-8?Q?State?= =?utf-8?Q?_Bank?=" <a@b.com>\nContent-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary=i\n\n--i\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n'
        + b64("https://one.org/a, https://two.org") + "\n--i--\n--o\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\n" + b64("https://pdf.org") + "\n--o\nContent-Type: text/html; charset=utf-16\nContent-Transfer-Encoding: base64\n\n" + b64("https://three.org", "utf-16") + "\n--o--\n",
        "broken": "From: =?utf-8?B?###?= <a@b.com>\nContent-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: base64\n\n!!!not base64",
        "plain": "From: State <a@b.com>\n\nhttps://p.org.",
        "media": "From: State <a@b.com>\nContent-Type: image/png\n\nhttps://p.org.",
        "null": None,
    }
    df = spark.createDataFrame(list(mails.items()), "k string, raw string")
    got = {r.k: (r.display, r.links) for r in letters.parsed(df, "raw", "k").collect()}
    assert got["base64"] == ("State Bänk", ["https://evil.example.com/pay"])
    assert got["quoted"] == ("State Bänk", ["https://evil.example.com/pay?a=1"])
    assert got["nested"] == ("State Bank", ["https://one.org/a", "https://two.org", "https://three.org"])
    assert got["broken"][1] == [] and got["plain"] == ("State", ["https://p.org"]) and got["media"] == ("State", []) and got["null"] == (None, [])
    brand = letters.parsed(df, "raw", "k").filter("k = 'nested'").select(letters.claimed_brand(F.col("display"), {"statebank": "State Bank"}).alias("b")).first()
    assert brand.b == "State Bank"


def test_ordinary_messages_read_as_the_email_package_reads_them():
    """Cut at marks or walked part by part, the text is the same."""
    part = lambda kind, how, x: f"--b\nContent-Type: {kind}\nContent-Transfer-Encoding: {how}\n\n{x}\n"
    bodies = ["aGVs\nbG8=\n", "aGVsbG8", "aGVsbG8=aGk=", "!!", "", "a=3Db =\nc\n", "=", "=zz", "x\n\ny", "--b\n", "--b--", " trailing \t\n"]
    raws = [f"From: a\nContent-Type: {k}\nContent-Transfer-Encoding: {e}\nX: y\n\n{b}" for k in ("text/plain", "TEXT/html; charset=no-such", "image/png", "odd", "text/plain;\n charset=iso-8859-1", "message/rfc822") for e in ("base64", "Quoted-Printable", "7bit", "x-uue", "base64 ") for b in bodies]
    for sub in ('boundary="b"', "boundary=b", "boundary=b; charset=x", ""):
        for kind in ("mixed", "digest", "alternative"):
            for inner in bodies:
                for tail in ("--b--\n", "--b--", "--b-- \nafter", ""):
                    raws.append(f"A: 1\nContent-Type: multipart/{kind}; {sub}\n\npre\n" + part("text/plain", "quoted-printable", inner) + part("image/png", "base64", inner) + part("text/html", "base64", inner) + tail)
    raws += ["Content-Type : text/plain\n\nx", " x\n\ny", "A: 1\nno colon\n\nx", "From me\nA: 1\n\nx", "A: 1\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nno head\n--b\nA: 1\n\nx\n--b--\n", "A: 1\nContent-Type: multipart/mixed; boundary=b\n\n--b\n--b\nA: 1\n\nx\n--b--", "A: é\n\né", "A: 1\n\nx\ry", "A: 1\n\nx\x0cy", "", "\n\n", "A: 1"]
    regular = 0
    for raw in raws:
        assert L.text_parts(raw) == "\n".join(L._walked(raw.encode("utf-8", "replace"))), raw
        regular += L._regular(raw) is not None
    assert regular > 200


def test_messages_are_parsed_once(spark):
    """Absent headers are not read again for each tracked one, and signals of messages without any domain or with a null one are told."""
    raws = [(1, "From: x <a@tionhs-login.top>\nReply-To: b@plain.org\n\nsee https://bad.example.com/x"), (2, None), (3, "Subject: s\n\nhttps://sub.bad.example.com/ https://plain.org/")]
    got = {r.o_orderkey: r.signals for r in L.mail_signals(spark, "", L.parsed(spark.createDataFrame(raws, "o_orderkey long, raw string"), "raw", "o_orderkey")).collect()}
    assert got == {1: ["auth_results_missing", "link_domain_confirmed", "lookalike_sender_domain", "reply_to_mismatch"], 2: [], 3: ["link_domain_confirmed"]}
    plan = L.parsed(spark.createDataFrame(raws, "o_orderkey long, raw string"), "raw", "o_orderkey").select("absent")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1
