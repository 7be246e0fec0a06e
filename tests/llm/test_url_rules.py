import random
import re

from forgelens.llm import url_rules as ur


def brute(url, rules):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow" if host else "block"


def run(spark, urls, rules, partitions=4):
    pages = spark.createDataFrame([(i, u, "h", 1, None) for i, u in enumerate(urls)], "page_id long, url string, Host string, rule int, _stack string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = ur.judge(pages, table, partitions).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


EDGES = [None, "", "nothing", "://", "http://", "http://Example.COM", "http://example.com/en/x", "https://a.b.EXAMPLE.com/en/", "http://www.example.com/en/?q=1", "http://x.www.example.com/en/#a", "ftp://example.com?x=/en/", "http://example.com/EN/",
         "http://notexample.com/en/", "http://example.com.net/es/1", "http://net/fr/", "http://net", "a://b://c/en/", "http://" + "x." * 3000 + "com/" + "y" * 9000, "http://exämple.com/en/", "http://example-x.com/en/", "http://com/", "http://.com/"]


def test_edges(spark):
    run(spark, EDGES + EDGES, ur.RULES)
    run(spark, [], ur.RULES)
    run(spark, EDGES, [])
    run(spark, EDGES, [("block", None, "/"), ("allow", "com", None), ("block", "com", "")])


def test_nested_rules_over_ranges(spark):
    rng = random.Random(1)
    labels = ["a", "b", "c-d", "c", "com", "net", "z9"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = sorted({(host(rng.randint(1, 4)), rng.choice(["", "/", "/x", "/x/y"])) for _ in range(60)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{host(rng.randint(1, 6))}{rng.choice(['', '/', '/x', '/x/y/z', '?q', '/x#f'])}" for _ in range(600)] + ["http://hot.com/x"] * 300
    for partitions in (1, 7, 40):
        run(spark, urls, rules, partitions)


def test_many_nested_paths(spark):
    """Many rules under one host, nested many deep, and a path that most pages have."""
    rng = random.Random(2)
    paths = ["/" + "a/" * n for n in range(40)] + [f"/{x}{y}" for x in "abcxyz" for y in ("", "/", "1", "1/2", "\U0001f600", "\x00", "é")]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in ("big.com", "x.big.com", "com") for p in paths] + [("allow", "big.com", "/a1"), ("block", "big.com", "/a1")]
    urls = [f"http://{rng.choice(['', 'x.', 'y.x.'])}big.com{rng.choice(paths)}{rng.choice(['', '/a/b', 'a/', '?q'])}" for _ in range(500)] + ["http://big.com/a/"] * 400
    for partitions in (1, 9):
        run(spark, urls, rules, partitions)


def test_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = ur.op10_url_rules(spark, sf).collect()
    assert len(got) == len(urls) and all(tuple(r)[1:] == brute(urls[r.page_id], ur.RULES) for r in got)
