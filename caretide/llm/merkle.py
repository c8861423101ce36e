"""A manifest of a dataset as a tree of digests: a root, a digest of each source, and a proof of every row.

Each row is a leaf.  The leaves of a source in the order of their ids, and then the sources' own digests in the order of
their names, make trees in which every 16 consecutive nodes have one parent; the last parent of a level has what is left.

Parents grow by events.  A node that is known goes to its parent, which gathers its children by their places until it has as
many as the size of the tree says; then its own digest is an event for its parent.  A task does so with the leaves of its
ranges and keeps nothing but open parents; those that its leaves leave open, a few on each level of a range, are combined
by key after a shuffle, where the next ancestors grow in the same way, until no parent is open.  Parents keep the digests
of their children, and these links are followed back from the root: a node's path is its parent's path and its own siblings,
handed down one level a join, to each run of leaves.  A path is expanded only beside the leaves of its run.

Defined cases: null columns are the digest's ``-``, which no value is; an empty text is ``0:``; ids may be null (first) or
repeat, then rows follow one another by digest, and equal rows are equal leaves; a null source is a source and comes first;
a source of one row has that leaf as its digest; one source alone is the root; very long texts are digested whole; an empty
table has no root and gives no rows; only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretide.llm import storage
from caretide.llm.ordering import numbered

ARITY = 16
SHIFT = ARITY.bit_length() - 1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LINK, OPEN, ROOT = 0, 1, 2
#: A node of a tree of ``n`` leaves: for a link its digest and those of its children; for an open parent the children it has
#: so far and their places; for a root its digest.
EVENTS = "kind int, tree string, n long, level int, index long, digest string, places array<int>, children array<string>"
PATH = "array<struct<left:string,right:string>>"
TEXT_TAMPERED = 5  #: of so many ids, by their checksum, one row's text is taken as tampered with


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf(columns: Sequence[str] = COLUMNS, **instead: Column) -> Column:
    """A row's digest, with other values for some of its columns."""
    return digest(F.concat(*[field(instead.get(c, F.col(f"`{c}`"))) for c in columns]))


def tree_name(source: Column) -> Column:
    """A name that is never null and sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


def _grow(batches):
    """Open parents, and places and digests of some of their children, to the links, roots and open parents that follow."""
    held: dict[tuple[str, int, int, int], dict[int, str]] = {}
    out: list[tuple] = []
    for batch in batches:
        for tree, n, level, index, places, children in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "index", "places", "children"))):
            own = dict(zip(places, children))
            while True:
                key = (tree, n, level, index)
                if key in held:
                    own = {**held.pop(key), **own}
                arity = min(ARITY, width(n, level - 1) - index * ARITY)
                if len(own) < arity:
                    held[key] = own
                    break
                digests = [own[k] for k in range(arity)]
                made = hashlib.sha256("".join(digests).encode()).hexdigest()
                out.append((LINK, tree, n, level, index, made, None, digests))
                if width(n, level) == 1:
                    out.append((ROOT, tree, n, level, 0, made, None, None))
                    break
                own, level, index = {index % ARITY: made}, level + 1, index // ARITY
        if len(out) >= 4096:
            yield _batch(out)
            out = []
    out += [(OPEN, *key, None, list(own), list(own.values())) for key, own in held.items()]
    yield _batch(out)


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in EVENTS.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds)], list(names))


@dataclass(frozen=True)
class Trees:
    """``links(tree, n, level, index, digest, children)``: every parent; ``roots(tree, n, digest)``."""

    links: DataFrame
    roots: DataFrame


def grown(leaves: DataFrame) -> Trees:
    """All trees over ``leaves(tree, n, index, digest)``: a leaf's index is its place from 0 among the ``n`` of its tree."""
    storage.prepare(leaves.sparkSession)
    alone = leaves.where("n = 1").select("tree", "n", "digest")
    parent = F.shiftright("index", SHIFT)
    place = F.array((F.col("index") % ARITY).cast("int"))
    events = leaves.where("n > 1").select("tree", "n", F.lit(1).alias("level"), parent.alias("index"), place.alias("places"), F.array("digest").alias("children"))
    links, roots = None, alone
    while True:
        found = storage.materialize(events.mapInArrow(_grow, EVENTS), "tree", compression="zstd")
        made = found.where(F.col("kind") == LINK).select("tree", "n", "level", "index", "digest", "children")
        links = made if links is None else links.unionByName(made)
        roots = roots.unionByName(found.where(F.col("kind") == ROOT).select("tree", "n", "digest"))
        still = found.where(F.col("kind") == OPEN)
        if still.isEmpty():
            return Trees(links, roots)
        # what tasks have of the same parent is combined; the next task closes it and goes on to its ancestors
        merged = still.groupBy("tree", "n", "level", "index").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("children")).alias("children"))
        events = merged.select("tree", "n", "level", "index", "places", "children")


def _siblings(children: Column, place: Column) -> Column:
    """What stands before and after a place in a run, as digests in one string each."""
    left = F.array_join(F.slice(children, F.lit(1), place), "")
    right = F.array_join(F.slice(children, place + 2, F.lit(ARITY)), "")
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def runs(trees: Trees, above: DataFrame) -> DataFrame:
    """``(tree, index, children, path)`` plus further columns of ``above(tree, path, ...)``: for every run of leaves the path
    of its parent to the top, where ``above`` has the path from the tree's root on."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    top = trees.links.agg(F.max("level")).first()[0] or 0
    root = trees.links.where(F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))).select("tree", "level", "index")
    roots = root.join(above, "tree")
    known = None
    for level in range(top, 0, -1):
        here = roots.where(F.col("level") == level).select("tree", "index", "path", *more)
        known = here if known is None else known.unionByName(here)
        links = trees.links.where(F.col("level") == level).select("tree", "index", "children")
        known = links.join(known, ["tree", "index"])
        if level > 1:
            nth = known.select("tree", "index", "children", "path", *more, F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("__nth"))
            below = F.concat(_siblings(F.col("children"), F.col("__nth")), F.col("path")).cast(PATH)
            known = nth.select("tree", (F.col("index") * ARITY + F.col("__nth")).alias("index"), below.alias("path"), *more)
    if known is None:
        return above.where(F.lit(False)).select("tree", F.lit(0).cast("long").alias("index"), F.array().cast("array<string>").alias("children"), "path", *more)
    return known.select("tree", "index", "children", "path", *more)


def paths(leaves: DataFrame, trees: Trees, above: DataFrame) -> DataFrame:
    """``leaves`` with the ``path`` of each, its own siblings first, and the further columns of ``above``."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    run = runs(trees, above).withColumnRenamed("index", "__run")
    many = leaves.where("n > 1").withColumn("__run", F.shiftright("index", SHIFT)).join(run, ["tree", "__run"])
    own = F.concat(_siblings(F.col("children"), (F.col("index") % ARITY).cast("int")), F.col("path")).cast(PATH)
    single = leaves.where("n = 1").join(above, "tree")
    return many.select(*leaves.columns, own.alias("path"), *more).unionByName(single.select(*leaves.columns, "path", *more))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"]))), ""))


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, own, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


@dataclass(frozen=True)
class Manifest:
    """``leaves(tree, n, index, digest, ...)``, the trees of the sources, the tree of their digests and the root of all."""

    leaves: DataFrame
    sources: Trees
    top_leaves: DataFrame
    top: Trees
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with its ``path`` to the root and the ``subroot`` of its source."""
        spark = self.leaves.sparkSession
        highest = spark.createDataFrame([("", [])], f"tree string, path {PATH}").coalesce(1)
        subroots = paths(self.top_leaves, self.top, highest).select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"))
        return paths(self.leaves, self.sources, storage.materialize(subroots, "subroots", compression="zstd"))

    def summary(self) -> DataFrame:
        """``(tree, n, digest)`` of every source, to be kept beside the root."""
        return self.sources.roots

    def save(self, path: str) -> None:
        """Store all nodes as Parquet; the root is written last, so a manifest without one is not whole."""
        frames = {"leaves": self.leaves, "links": self.sources.links, "roots": self.sources.roots, "top_leaves": self.top_leaves, "top_links": self.top.links, "top_roots": self.top.roots}
        for name, frame in frames.items():
            frame.write.option("compression", "zstd").parquet(f"{path}/{name}")
        self.leaves.sparkSession.createDataFrame([(self.root,)], "root string").coalesce(1).write.parquet(f"{path}/root")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        root = spark.read.schema("root string").parquet(f"{path}/root").first()[0]
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("leaves"), Trees(read("links"), read("roots")), read("top_leaves"), Trees(read("top_links"), read("top_roots")), root)

    def changed_sources(self, later: Manifest) -> DataFrame:
        """``(tree, n_before, n_after)`` of the sources whose digests differ; a source that one of the two lacks has null there.
        Equal roots need no look at the sources."""
        if self.root == later.root:
            return self.summary().where(F.lit(False)).select("tree", F.col("n").alias("n_before"), F.col("n").alias("n_after"))
        before = self.summary().select("tree", F.col("n").alias("n_before"), F.col("digest").alias("__before"))
        after = later.summary().select("tree", F.col("n").alias("n_after"), F.col("digest").alias("__after"))
        both = before.join(after, "tree", "full").where(~F.col("__before").eqNullSafe(F.col("__after")))
        return both.select("tree", "n_before", "n_after")

    def _runs(self, changed: DataFrame, name: str) -> DataFrame:
        """Runs of leaves of some sources."""
        many = self.sources.links.where("level = 1").select("tree", "index", "digest", "children")
        alone = self.leaves.where("n = 1").select("tree", "index", "digest", F.array("digest").alias("children"))
        return many.unionByName(alone).join(changed, "tree", "left_semi").select("tree", "index", F.col("digest").alias(f"__{name}_run"), F.col("children").alias(name))

    def changed_leaves(self, later: Manifest) -> DataFrame:
        """``(tree, index, before, after)`` of the places whose leaves differ, null where one of the two has no such place.

        Of sources that differ the digests of runs are compared, a sixteenth of the leaves, and only runs that differ are
        looked into.  A row that comes in moves the places after it.
        """
        changed = self.changed_sources(later).select("tree")
        both = self._runs(changed, "before").join(later._runs(changed, "after"), ["tree", "index"], "full").where(~F.col("__before_run").eqNullSafe(F.col("__after_run")))
        none = F.array().cast("array<string>")
        pairs = both.select("tree", "index", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
        spread = pairs.select("tree", "index", F.posexplode(F.arrays_zip("before", "after")).alias("__nth", "__pair"))
        differ = spread.where(~F.col("__pair.before").eqNullSafe(F.col("__pair.after")))
        return differ.select("tree", (F.col("index") * ARITY + F.col("__nth")).alias("index"), F.col("__pair.before").alias("before"), F.col("__pair.after").alias("after"))


def manifest(leaves: DataFrame, order: Sequence[str], keep: Sequence[str] = ()) -> Manifest:
    """Of ``leaves(tree, digest)``, in each tree in the order of some columns; ``keep`` names columns that stay with a leaf."""
    placed = numbered(leaves.select("tree", "digest", *dict.fromkeys([*order, *keep])), [F.col(c).asc_nulls_first() for c in (*order, "digest")], ["tree"], "index", "n")
    placed = storage.materialize(placed.select("tree", "n", "index", "digest", *keep), "leaves", compression="zstd")
    sources = grown(placed)
    sources = Trees(sources.links, storage.materialize(sources.roots, "source-roots", compression="zstd"))
    top_leaves = numbered(sources.roots.select(F.col("tree").alias("source_tree"), "digest"), ["source_tree"], (), "index", "n").withColumn("tree", F.lit(""))
    top_leaves = storage.materialize(top_leaves, "top-leaves", compression="zstd")
    top = grown(top_leaves)
    found = top.roots.select("digest").first()
    return Manifest(placed, sources, top_leaves, top, found and found[0])


def verified(proofs: DataFrame, now: str, root: str | None) -> DataFrame:
    """Proofs with ``folded_root``, from the leaf's digest in the column ``now``, and whether it is the root."""
    return proofs.withColumn("folded_root", folded(F.col(now), F.col("path"))).withColumn("verified", F.col("folded_root") == F.lit(root))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and, after some texts are tampered with, the root that still follows, for all ``documents``."""
    docs = storage.table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TEXT_TAMPERED == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a row that is not tampered with has its own leaf there
    now = F.when(hit, leaf(text=lowered))
    made = manifest(docs.select(tree_name(F.col("source")).alias("tree"), leaf().alias("digest"), "doc_id", now.alias("tampered")), ["doc_id"], ["doc_id", "tampered"])
    proofs = made.proofs().withColumn("now", F.coalesce("tampered", "digest"))
    found = verified(proofs, "now", made.root)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


ORACLE_SQL = r"""WITH RECURSIVE bits AS (SELECT CAST(i AS BIGINT) AS v, i, 0 AS k FROM range(256) r(i) UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, coalesce('s' || source, '') AS tree, text,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, crc.c[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, crc),
h AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM d),
leaves AS (SELECT *, coalesce(tampered, leaf) AS now, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h),
nodes AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves UNION ALL SELECT tree, any_value(level) + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, idx // 16),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS idx, count(*) OVER () AS n, digest, tree FROM subroots UNION ALL SELECT any_value(level) + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), NULL FROM tops WHERE n > 1 GROUP BY idx // 16),
runs AS (SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM tops WHERE n > 1 GROUP BY ALL),
climb AS (SELECT doc_id, tree, leaf, idx AS row_idx, 0 AS level, idx, now AS fold, '' AS proof FROM leaves
  UNION ALL SELECT c.doc_id, c.tree, c.leaf, c.row_idx, c.level + 1, c.idx // 16, sha256(array_to_string(r.ds[1:c.idx % 16], '') || c.fold || array_to_string(r.ds[c.idx % 16 + 2:], '')),
    c.proof || array_to_string(r.ds[1:c.idx % 16], '') || array_to_string(r.ds[c.idx % 16 + 2:], '') FROM climb c JOIN runs r ON c.tree = r.tree AND c.level = r.level AND c.idx // 16 = r.run),
at_source AS (SELECT c.* FROM climb c JOIN (SELECT tree, max(level) AS level FROM nodes GROUP BY 1) m ON c.tree = m.tree AND c.level = m.level),
rise AS (SELECT a.doc_id, a.tree, a.leaf, t.digest AS subroot, 0 AS level, t.idx, a.fold, a.proof FROM at_source a JOIN tops t ON t.level = 0 AND a.tree = t.tree
  UNION ALL SELECT c.doc_id, c.tree, c.leaf, c.subroot, c.level + 1, c.idx // 16, sha256(array_to_string(r.ds[1:c.idx % 16], '') || c.fold || array_to_string(r.ds[c.idx % 16 + 2:], '')),
    c.proof || array_to_string(r.ds[1:c.idx % 16], '') || array_to_string(r.ds[c.idx % 16 + 2:], '') FROM rise c JOIN top_runs r ON c.level = r.level AND c.idx // 16 = r.run),
done AS (SELECT max(level) AS level, arg_max(digest, level) AS root FROM tops)
SELECT r.doc_id, r.leaf, r.subroot, d.root, sha256(r.proof) AS proof_sha256, r.fold AS folded_root, r.fold = d.root AS verified FROM rise r JOIN done d ON r.level = d.level"""
