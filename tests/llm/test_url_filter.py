import bisect
import random
from collections import Counter

from pyspark.sql import functions as F

from tablelens.llm import url_filter
from tablelens.llm.url_filter import filter_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "", "allow"), ("example.org", "/e", "block")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:n].translate(LOWER), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h) + len(p), -len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def run(spark, df, rules=RULES, **kw):
    out = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), **kw)
    return sorted(((r.doc.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=repr)


def test_against_brute_force(spark, frame):
    rng = random.Random(3)
    hosts = ["org", "example.org", "www.example.org", "a.example.org", "x.a.example.org", "example.com", "notexample.org", "Example.ORG",
             "example.org.", "", "example-x.org", "é.com", "net", "org.example", "u:p@example.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/en/2#f", "/fr/1", "/de/", "?q=1://x", "#t", "/eé"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "mailto:x", "http://" + "a." * 5000 + "org/" + "p" * 50_000]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(5, urls[5], "x")] * 40
    df = frame(rows, "page_id long, url string, host string")
    want = sorted(((i, *brute(u, RULES)) for i, u, _ in rows), key=repr)
    assert run(spark, df) == want
    assert run(spark, df, ranges=17) == want
    assert run(spark, df, ranges=1) == want


def test_many_nested_rules(spark, frame):
    rng = random.Random(4)
    rules = sorted({(".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), "/" * rng.randrange(3), "block") for _ in range(200)})
    rows = [(i, "http://" + ".".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) + "/" * rng.randrange(3)) for i in range(400)]
    got = run(spark, frame(rows, "page_id long, url string"), rules, ranges=9)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)


def test_empty_tables(spark, frame):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert run(spark, empty) == []
    assert run(spark, frame([(1, "http://a.org/")], "page_id long, url string"), rules=[]) == [(1, "a.org", "/", None, "allow")]
    odd = [(None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("org", "/", None)]
    assert run(spark, frame([(None, "http://a.org/")], "page_id long, url string"), rules=odd) == [(None, "a.org", "/", None, "allow")]


def test_split_points_cost_the_driver_the_same_for_any_number_of_tasks(spark, monkeypatch):
    sizes, own = [], url_filter.collect_bounded

    def seen(df, bound):
        rows = own(df, bound)
        sizes.append(len(rows))
        return rows
    monkeypatch.setattr(url_filter, "collect_bounded", seen)
    keys = spark.range(0, 40_000, 1, 50).select(F.concat(F.lit("k"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0")).alias("key"),
                                               F.xxhash64("id").alias("tie"))
    keys = keys.unionAll(spark.range(20_000).select(F.lit("hot").alias("key"), F.lit(1).cast("long").alias("tie")))
    points = url_filter._split_points(keys, 8)
    assert points == sorted(points) and len(points) <= 7 and sizes[0] < 4 * 24 * 8
    bounds = [bisect.bisect_right(points, (r["key"], r["tie"])) for r in keys.collect()]
    assert sorted(Counter(bounds).values())[-2] < 15_000  # all but the range of the hot key
