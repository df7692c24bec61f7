from quire.llm import url_filter as U
from quire.llm.queries import URL_RULES, op4_url_filter

SF = "/root/testdata/sf0.001"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:end]


def rule_of(host, path, rules):
    fits = [(len(h + p), a, h + p) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))


def test_query_matches_brute_force(spark):
    rows = {r["page_id"]: r for r in op4_url_filter(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host, path = parts(r["url"])
        _, action, rule = rule_of(host, path, URL_RULES)
        got = rows.pop(r["page_id"])
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, action or "allow")
    assert not rows


def test_aliases_and_precedence(spark):
    html = '<head><LINK href="{}" class=x rel="canonical"></head>'
    refresh = '<meta content="0; URL=\'/moved?a=1&amp;b=2\'" http-equiv=refresh>'
    pages = spark.createDataFrame([
        (1, "http://a.org/x#top", html.format("http://Bad.net/y"), "p"), (2, "http://b.org/z", html.format("//a.org/x"), "p"),
        (3, "http://ok.net/en/1", html.format("http://bad.net/y"), "p"), (4, "http://a.org/other", None, "p"),
        (5, None, html.format("http://bad.net/"), "p"), (6, "no scheme", "", "p"), (6, "no scheme", "", "p"),
        (7, "HTTP://X.COM?q=://", "", "p"), (8, "http://c.org/start", refresh, "p"), (9, "http://c.org/moved?a=1&b=2", "", "p"),
        (10, "http://bad.net", "x" * 100000, "p"), (None, "http://[bad", html.format("http://[x"), "p")],
        "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame([("net", "/", "block"), ("ok.net", "/en/", "allow"), ("ok.net", "/en/", "allow"),
                                   ("c.org", "/start", "block"), ("tie.org", "/", "allow"), ("tie.org", "/", "block")],
                                  "host string, path string, action string")
    redirects = spark.createDataFrame([("http://b.org/z", "http://far.org/"), (None, "http://far.org/"),
                                       ("http://far.org/", "http://far.org/")], "a string, b string")
    got = {}
    for r in U.judge(pages, rules, redirects).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.org", "/x", None, "block")] and got[2][0][3] == "block"
    assert got[3] == [("ok.net", "/en/1", "ok.net/en/", "allow")]
    assert got[4][0][3] == "allow" and got[5] == [("", "", None, "allow")] and got[6] == [("", "", None, "allow")] * 2
    assert got[7] == [("x.com", "", None, "allow")]
    assert got[8][0][2:] == ("c.org/start", "block") and got[9][0][3] == "block"
    assert got[10] == [("bad.net", "", None, "allow")]
    tie = spark.createDataFrame([("tie.org", "/")], "host string, path string")
    assert U.longest_rule(tie, rules).first()["action"] == "block"
    assert U.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in U.judge(pages, rules.where("false")).collect()} == {"allow"}


def test_many_rules_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 1)
    test_aliases_and_precedence(spark)
