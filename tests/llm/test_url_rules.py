from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from caretide.llm import url_rules


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([k for k in (rest.find(c) for c in "?#") if k >= 0], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    longest = max(f[:2] for f in fits)
    best = [f for f in fits if f[:2] == longest]
    verdict = "block" if any(f[4] == "block" for f in best) else "allow"
    return host, path, best[0][2] + best[0][3], verdict


def judged(spark, urls, rules, **more):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ruled = spark.createDataFrame(rules, "verdict string, host string, path string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(frame, ruled, **more).collect()}


def test_query_matches_sql_and_brute_force(spark, small):
    got = {tuple(r) for r in url_rules.query(spark, small).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    assert got == set(con.sql(url_rules.ORACLE_SQL).fetchall())
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert got == {(i, *plain(u, url_rules.RULES)) for i, u in urls.items()}


def test_nested_and_hot_hosts(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c", "www", "com", "net", "co-m", "x,y", ""]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab/", "//", "/é/"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(80)]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'c/d', '?q=/a', '#f'])}" for _ in range(600)]
    urls += [urls[0]] * 900 + [None, "", "no scheme/a", "HTTP://WWW.A.COM/a", "a://b://c/a", "://com/a", "x://com\n/a\n/b"]
    got = judged(spark, urls, rules, partitions=7)
    assert got == {k: plain(u, rules) for k, u in enumerate(urls)}


def test_hot_url_is_split(spark):
    frame = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("https://one.example.com/en/x").alias("url"))
    rules = spark.createDataFrame([("block", "example.com", "/en/")], "verdict string, host string, path string")
    found = url_rules.judge(frame, rules, partitions=6).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in found) == 3000 and max(r["count"] for r in found) < 1000


def test_edge_rows(spark, edge, empty):
    rules = spark.createDataFrame([("block", "com", "/"), (None, "net", "/"), ("block", None, "/"), ("allow", "com", None)], "verdict string, host string, path string")
    urls = edge.withColumn("url", F.when(F.col("doc_id") == 1, "http://a.com/x")).withColumn("rule", F.lit("clash")).withColumn("host", F.lit(0))
    out = url_rules.judge(urls, rules, default="block")
    assert out.columns == ["doc_id", "text", "lang", "a.b", "url", *url_rules.OUTPUTS]
    rows = out.collect()
    assert len(rows) == 9 and {(r.doc_id, r.rule) for r in rows if r.rule} == {(1, "com/")}
    assert url_rules.judge(empty, rules, url="text").count() == 0
    assert url_rules.judge(urls, rules.limit(0)).where("rule is not null").count() == 0


def test_the_number_of_paths_of_a_host_does_not_matter(lines_run):
    rng, work = random.Random(4), []
    for n in (500, 5000):
        active = url_rules.Active()
        paths = [f"/{rng.randrange(10**6):06d}/{rng.randrange(10**6):06d}" + "x" * rng.randrange(30) for _ in range(n)]
        for p in paths:
            active.add("com.", "com", p, "block")
        asked = [rng.choice(paths) + "/more" for _ in range(50)] + ["/none", ""]
        for a in asked:
            longest = max((p for p in paths if a.startswith(p)), key=len, default=None)
            assert active.longest(a) == (longest and ("com" + longest, "block"))
        work.append(lines_run(lambda: [active.longest(a) for a in asked]))
    assert work[1] < 1.5 * work[0]
