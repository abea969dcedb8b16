"""URL verdicts against a scan of all rules."""

from plumbrow.llm import urls

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("b.example.org", "/f", "block"), ("Upper.com", "", "block"), ("tie.io", "/x", "allow"), ("tie.io", "/x", "block"), ("", "/", "block"), (None, "/", "block"), ("nul.io", None, "block"),
]
URLS = [
    None, "", "no mark", "://", "http://", "http:///path", "http://NET/", "http://a.net", "http://a.net/", "https://x.example.net/en/1?q=/de/",
    "https://x.example.net/EN/1", "https://notexample.com/de/", "https://example.com/de/", "https://a.example.com/de", "ftp://b.example.org/fr/1#x",
    "https://c.b.example.org/f", "https://UPPER.com", "https://tie.io/xyz", "https://a.org?x", "http://a://b.net/en/", "http://xn.é.net/ü", "https://nul.io#a",
    "http://a.net/" + "deep/" * 5000, "http://" + "a." * 3000 + "net/",
]


def brute(url, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), v == "block", h + p, v))
    return (host, path, *max(fits)[3:]) if fits else (host, path, None, default)


def test_against_all_rules(spark):
    many = URLS + [URLS[9]] * 50
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(many)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, rules, keep=["page_id"]).collect()}
    assert len(got) == len(many)
    for i, u in enumerate(many):
        assert got[i] == brute(u), u


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_urls(pages, rules, default="block").first().verdict == "block"
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_only_dataframe_functions(spark, sf):
    from plumbrow.llm.queries import QUERIES

    for name in ("op7_secrets", "op9_url_verdicts"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))
