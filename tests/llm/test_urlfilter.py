import random

import pytest

from concord.llm import queries, urlfilter

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, html string, rule string, start string"


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    found = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(found, default=(0, 0, 0, None, urlfilter.DEFAULT))
    return host, path, best[3], best[4]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, None, "clash", "clash") for k, u in enumerate(urls)], PAGES)
    return urlfilter.judge(pages, spark.createDataFrame(rules, RULES))


URLS = [
    None,
    "",
    "example.org/es/",
    "http://",
    "http://example.org",
    "http://example.org/",
    "http://EXAMPLE.org/es/1?x=/en/1",
    "https://a.b.example.org/en/12#/es/",
    "https://badexample.org/en/12",
    "x://org/es/",
    "x://.org/es/",
    "x://a..example.org/en/1",
    "a://b://c.org/d",
    "http://ÄÖ.Example.ORG/es/ü",
    "http://shop.com/de/" + "x" * 20_000,
    "http://" + "a." * 3000 + "com/fr/",
    "http://user@example.org:80/es/",
    "http://a.com?/fr/",
    "http://a.com\n.org/fr/\n",
]


def test_awkward_urls(spark):
    urls = URLS + URLS
    rows = judged(spark, urls, queries.URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {
        k: plain(u, queries.URL_RULES) for k, u in enumerate(urls)
    }
    assert len(rows) == len(urls)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    hosts = [".".join(rng.choices(["a", "b", "org", ""], k=rng.randint(1, 4))) for _ in range(12)]
    paths = ["", "/", "/a", "/a/", "/ab", "/b/c", "x"]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(14)]
    rules += [(None, "/", "block"), ("a", None, "block"), rules[0]]
    urls = [f"h://{rng.choice(hosts)}{rng.choice(['', '/', '/a/b', '/abc', '/b/c/d?e', '#x'])}" for _ in range(80)]
    rows = judged(spark, urls, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: plain(u, rules) for k, u in enumerate(urls)}


def test_short_prefixes_are_confirmed_by_whole_digests(spark, monkeypatch):
    """With one digit nearly every lookup meets a wrong rule."""
    monkeypatch.setattr(urlfilter, "PREFIX_DIGITS", 1)
    rows = judged(spark, URLS, queries.URL_RULES).collect()
    assert {r.page_id: r.rule for r in rows} == {k: plain(u, queries.URL_RULES)[2] for k, u in enumerate(URLS)}


def test_long_lists_cost_a_url_only_its_own_rules(spark):
    """2,000 rules of 400 lengths for other hosts make no expression; those of a URL's host one for each length."""
    rules = [(f"h{k % 97}.net", "/" + "p" * (k % 400), "block") for k in range(2_000)] + [("a.org", "/x", "block"), ("org", "/xy/z", "allow")]
    urls = spark.createDataFrame([("b.a.org", "/xy/z" + "p" * 500), ("h5.com", "/" + "p" * 500)], "host string, path string")
    known = urlfilter.hashed_rules(spark.createDataFrame(rules, RULES))
    ruled = urlfilter.hosts_with_rules(urls.select("host").distinct(), known)
    assert urlfilter.expressions(urls, ruled).count() == 2
    rows = judged(spark, ["h://b.a.org/xy/z/p", "h://h5.com/ppp", "h://x.h5.net/" + "p" * 399], rules).collect()
    assert [r.verdict for r in sorted(rows, key=lambda r: r.page_id)] == ["allow", "allow", "block"]


def test_no_rules_and_no_pages(spark):
    rows = judged(spark, URLS, []).collect()
    assert {r.verdict for r in rows} == {urlfilter.DEFAULT}
    assert {r.rule for r in rows} == {None}
    assert judged(spark, [], queries.URL_RULES).collect() == []
