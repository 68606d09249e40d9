import re

import pytest

from basinframe.llm import urlfilter
from basinframe.llm.urlfilter import HOST_RULES, PATTERN_RULES, host_rule, pattern_rule

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/EN/", "http://example.net", "http://example.net/", "http://net/x",
    "http://notnet/x", "x://example.com/de/1?q=/de/", "http://example.com?u=http://b.net/", "http://b.org/fr/#", "http://org/fr",
    "http://a.b.org/fr/x", "no scheme", "", None, "http://ads.x.com/", "http://x.com/banner/1", "http://x.com/a.exe",
    "http://x.com/a.exe?b", "http://example.org/banner/1", "http://tracker.example.org/", "http://myads.x.com/", "://net/",
    "http://user@h.net/", "http://h.net:80/", "http://x.com/" + "a/" * 20_000, "http://e.com/x\n.net/",
]


def slow(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = []
    for action, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), h + p, action))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    found = [r for r in PATTERN_RULES[:7] if re.search(r.regex, text, re.DOTALL)]
    verdict = "allow" if not found or any(r.action == "allow" for r in found) else "block"
    return host, path, None, verdict


@pytest.mark.parametrize("at_once", [100, 2])
def test_verdicts(spark, at_once):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, host string, found int")
    got = urlfilter.judge(pages, [*HOST_RULES, *PATTERN_RULES[:7]], rules_at_once=at_once).collect()
    want = sorted(((k, *slow(u)) for k, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want


CASES = {
    "http://ads.x.com/": "block", "http://ADS.x.com/": "block", "HTTP://a.AdServer.b.dev/": "block", "http://tracker.a.io/1": "block", "http://myads.x.com/": "allow",
    "http://ads/": "allow", "http://x.com/BANNER/1": "block", "http://x.com/setup.EXE": "block", "http://ads.Example.org/": "allow", "http://ads.x.NET/": "block",
    "http://x.com/ads.html": "allow", "http://EXAMPLE.COM/de/1": "block", "http://example.com/DE/1": "allow", "http://a.org/FR/": "allow",
    "http://spam.io/p/1": "block", "http://spam.io/P/1": "block", "http://SPAM.io/p/1?x": "block", "http://www.spam.io/p/1#x": "block", "http://spam.io/p/12": "allow",
    "http://notspam.io/p/1": "allow", "http://spam.io/p/1/2": "block", "http://once.io/p/1": "allow", "http://x.com/?u=http://spam.io/p/1": "allow", "spam.io/p/1": "allow",
    "http://spam.io/p/1\u00e9": "block", "//ads.x.com/": "allow", "http://\u212aads.x.com/": "allow", "http://odd.io/a*b": "allow",
}


def test_verdicts_of_any_case(spark):
    pages = spark.createDataFrame([(u,) for u in CASES], "url string")
    listed = spark.createDataFrame([("http://spam.io/p/1?a",), ("http://Spam.io/P/1",), ("http://odd.io/a*b",), ("http://odd.io/a*b",), ("http://odd.io/a*b",), ("http://once.io/p/1",), (None,)], "url string")
    repeated = urlfilter.repeated_addresses(listed, most=1)
    assert [r.name for r in repeated] == ["||spam.io/p/1^"]
    assert {r.url: r.verdict for r in urlfilter.judge(pages, [*HOST_RULES, *PATTERN_RULES, *repeated]).collect()} == CASES


def test_sql_says_the_same_of_odd_urls(spark, tmp_path):
    import duckdb

    rows = list(enumerate([*URLS, *CASES, *CASES, "http://spam.io/p/1"]))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = {r[0]: r[-1] for r in con.execute("SELECT page_id, verdict FROM (" + urlfilter.ORACLE + ")").fetchall()}
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.verdict for r in urlfilter.op10_urlfilter(spark, str(tmp_path)).collect()} == want


def test_counts_agree_however_tokens_travel(spark, monkeypatch):
    pages = spark.createDataFrame([(u,) for u in URLS], "url string")
    rules = [*HOST_RULES, *PATTERN_RULES]
    sent = urlfilter.token_counts(pages, "url", rules)
    monkeypatch.setattr(urlfilter, "TOKENS_SENT", 1)
    assert urlfilter.token_counts(pages, "url", rules) == sent and sent["net"] > 3


def test_index_finds_what_all_rules_find():
    words = ["ads", "x", "banner", "shop", "en", "com", "net", "a1"]
    rules = [pattern_rule(p) for p in ("/x/", "ads*banner", "||shop.^", "|http://a1", "en|", "*", "^net^", "x-y*", "@@/shop/ads/")]
    rules += [host_rule("block", "com/x"), host_rule("allow", "shop.com/x/en"), host_rule("block", "a1/")]
    index = urlfilter.Index(rules, {w: k for k, w in enumerate(words)})
    import random

    rng = random.Random(1)
    for _ in range(3000):
        host = ".".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        path = "".join(rng.choice("/.-_") + rng.choice(words) for _ in range(rng.randint(0, 4)))
        url, target = f"http://{host}{path}", f"{host}{path}" if path.startswith("/") else host + path
        fits = [r for r in rules if (re.match(r.regex, target) if r.host else re.search(r.regex, url))]
        assert index.best(url, target) == max(fits, key=lambda r: r.rank(), default=None), url


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert urlfilter.judge(pages, []).first().verdict == "allow"
    assert urlfilter.judge(pages.limit(0), list(HOST_RULES)).collect() == []
