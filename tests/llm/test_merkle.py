from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from caretide.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    """Root, and for each leaf its siblings level by level as (left, right) lists."""
    levels, paths = [digests], [[] for _ in digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k in range(len(digests)):
            at = k // 16 ** (len(levels) - 1)
            lo = at // 16 * 16
            paths[k].append((now[lo:at], now[at + 1 : lo + 16]))
        levels.append([H(*now[k : k + 16]) for k in range(0, len(now), 16)])
    return levels[-1][0], paths


def fold(own, path):
    for left, right in path:
        own = H(*left, own, *right)
    return own


def plain(docs):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: H(*map(part, (d[0], d[1], d[2], d[3], text)))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in sources:
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        trees.append((own, *plain_tree([leaf(d, d[4]) for d in own])))
    root, above = plain_tree([t[1] for t in trees])
    for (own, subroot, paths), top in zip(trees, above):
        for d, path in zip(own, paths):
            whole = path + top
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            now = leaf(d, lower(d[4]) if hit else d[4])
            out.append((d[0], leaf(d, d[4]), subroot, root, H(*(x for left, right in whole for x in (*left, *right))), fold(now, whole), fold(now, whole) == root))
    return sorted(out, key=str)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def stored(spark, tmp_path, docs, name="documents"):
    spark.createDataFrame(docs, COLUMNS).repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def found(spark, folder):
    return sorted((tuple(r[c] for c in RESULT) for r in merkle.query(spark, folder).collect()), key=str)


def corpus(rng, n):
    names = ["hot"] * 4 + [None, "", "Zeta", "alpha", "é", "lone"]
    docs = [(k, rng.choice(names[:-1]), rng.choice(["en", None]), rng.choice([k, None]), rng.choice(["Some Text", "lower", "", None, "ÄÖ Mixed Ü"]) and f"Text {k}") for k in range(n)]
    return docs + [(n, "lone", "en", 1, "x"), (None, "hot", None, None, None), (3, "hot", "en", 1, "A"), (3, "hot", "en", 1, "A"), (3, "hot", "en", 1, "B")]


@pytest.mark.parametrize("n", [0, 40, 700])
def test_against_a_tree_built_in_one_place(spark, tmp_path, n):
    docs = corpus(random.Random(n), n)
    assert found(spark, stored(spark, tmp_path, docs)) == plain(docs)


def test_many_sources_and_the_sql(spark, tmp_path):
    rng = random.Random(1)
    docs = [(k, f"s{rng.randrange(70)}", "en", k, f"Text {k}" * rng.randrange(3)) for k in range(400)] + [(900, None, None, None, None)]
    folder = stored(spark, tmp_path, docs)
    assert found(spark, folder) == plain(docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(RESULT)} FROM ({merkle.ORACLE_SQL})").fetchall(), key=str) == plain(docs)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 4097])
def test_sizes_of_one_source(spark, n):
    digests = [H(str(k)) for k in range(n)]
    leaves = spark.createDataFrame([("t", n, k, d) for k, d in enumerate(digests)], "tree string, n long, index long, digest string").repartition(4)
    trees = merkle.grown(leaves)
    root, paths = plain_tree(digests)
    assert [tuple(r) for r in trees.roots.collect()] == [("t", n, root)]
    above = spark.createDataFrame([("t", [])], f"tree string, path {merkle.PATH}")
    for r in merkle.paths(leaves, trees, above).collect():
        assert [(p.left, p.right) for p in r.path] == [("".join(a), "".join(b)) for a, b in paths[r["index"]]]


def test_parents_close_within_a_task_where_their_leaves_are(spark):
    n = 5000
    leaves = spark.range(0, n, 1, 4).select(F.lit("t").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    parent = leaves.select("tree", "n", F.lit(1).alias("level"), F.shiftright("index", 4).alias("index"), F.array((F.col("index") % 16).cast("int")).alias("places"), F.array("digest").alias("children"))
    out = parent.mapInArrow(merkle._grow, merkle.EVENTS).groupBy("kind").count().collect()
    kinds = {r.kind: r["count"] for r in out}
    assert kinds[merkle.OPEN] <= 4 * 4 * 2 and kinds[merkle.LINK] >= n / 16


def test_any_change_of_a_row_shows(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", f"text {k}") for k in range(200)], "id long, source string, text string")
    columns = ("id", "source", "text")
    made = merkle.manifest(docs.select(merkle.tree_name(F.col("source")).alias("tree"), merkle.leaf(columns).alias("digest"), "id"), ["id"], ["id"])
    now = docs.withColumn("text", F.when(F.col("id").isin(5, 77), F.lit("changed")).otherwise(F.col("text"))).select("id", merkle.leaf(columns).alias("now"))
    wrong = merkle.verified(made.proofs().join(now, "id"), "now", made.root).where("NOT verified")
    assert {r.id for r in wrong.collect()} == {5, 77}
    assert {r.n for r in made.summary().collect()} == {66, 67}


def test_edges(spark, tmp_path, edge):
    assert found(spark, stored(spark, tmp_path / "a", [])) == []
    long = ("Word " * 60_000) + "End"
    docs = [(1, "s", "en", 1, "One"), (1, "s", "en", 1, "One"), (2, None, None, None, None), (None, "s", "en", None, ""), (5, "t", "en", 5, long)]
    spark.createDataFrame([(*d, "x", 1) for d in docs], COLUMNS + ", tree string, digest int").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert found(spark, f"{tmp_path}/b") == plain(docs)


def made_of(docs, columns=("id", "source", "text")):
    return merkle.manifest(docs.select(merkle.tree_name(F.col("source")).alias("tree"), merkle.leaf(columns).alias("digest"), "id"), ["id"], ["id"])


def test_two_versions_are_compared_from_the_top(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"s{k % 4}", f"text {k}") for k in range(400)] + [(900, "lone", "x"), (901, "gone", "y")], "id long, source string, text string")
    later = docs.where("source <> 'gone'").withColumn("text", F.when(F.col("id").isin(5, 77, 900), F.lit("changed")).otherwise(F.col("text")))
    later = later.unionByName(spark.createDataFrame([(500, "s2", "one more"), (501, "new", "z")], later.schema))
    before, after = made_of(docs), made_of(later)
    before.save(str(tmp_path / "before"))
    stored = merkle.Manifest.load(spark, str(tmp_path / "before"))
    assert stored.root == before.root and sorted(map(tuple, stored.summary().collect())) == sorted(map(tuple, before.summary().collect()))
    assert {tuple(r) for r in stored.changed_sources(after).collect()} == {("ss1", 100, 100), ("slone", 1, 1), ("sgone", 1, None), ("ss2", 100, 101), ("snew", None, 1)}
    got = {(r.tree, r["index"], r.before is None, r.after is None) for r in stored.changed_leaves(after).collect()}
    assert got == {("ss1", 1, False, False), ("ss1", 19, False, False), ("slone", 0, False, False), ("sgone", 0, False, True), ("ss2", 100, True, False), ("snew", 0, True, False)}
    assert before.changed_sources(stored).count() == 0 and before.changed_leaves(stored).count() == 0
    assert merkle.verified(stored.proofs().withColumn("now", F.col("digest")), "now", before.root).where("NOT verified").count() == 0
