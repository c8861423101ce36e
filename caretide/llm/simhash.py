"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

A pair within the threshold of 4 bits differs in at most one bit on some triple of six 10-bit blocks: ``TRIPLES`` holds
a triple for every way in which up to 4 differences can fall.  On the 30 bits of a triple, the words of the Hamming code
of length 31 are the anchors: every bit string is within 1 of exactly one of them (covering radius 1).  A fingerprint
lives at that anchor and also visits every anchor within covering radius plus threshold, 1 + 1 bits: at most 16.  Two
fingerprints that differ in at most one bit of the triple therefore meet at the home of either, where all 64 bits are
compared.  Only distinct fingerprints are replicated, so copies cost nothing, and each block of an anchor's comparisons
emits a forest of its links, never all pairs.  Links join into groups by iterated stars.

An anchor that very many fingerprints visit is covered again on the 34 bits outside its triple, cut into six blocks: a
pair within the threshold agrees on two of them, so such an anchor's visitors meet once for each pair of blocks with equal
content, spread over all tasks.  Those anchors are found beforehand: few words reach an anchor, so one with many visitors
is reached by a word that many fingerprints share, and counting words is cheap.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any other; a text
of fewer words than a shingle is one shingle; very long texts are read whole, their hashes summed in blocks; null ids never
name a group unless all ids of it are null; repeated rows are all kept, each with its group; an empty table gives no
rows; the result has its own columns, so names of others cannot clash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage
from caretide.llm.components import components, local_stars

SEED = 42
BLOCK_BITS = 10
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
THRESHOLD = 4
CODE_LENGTH = 31
#: Above so many rows, those that meet are compared by further blocks of bits instead of all with all.
DENSE = 1024
#: An anchor that may have more visitors is split.  At most 466 words reach one: 30 bits, 0 to 2 of them changed.
HOT, REACHING = 100_000, 466
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle_words].tolist()]
        hash64 = xxhash.xxh64_intdigest
        hashes = np.array([hash64(data[lo:hi], SEED) for lo, hi in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if len(hashes) == 1:
        return int(hashes[0])
    set_bits = np.zeros(64, np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(octets), 1 << 14):
        set_bits += np.unpackbits(octets[lo : lo + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = 4) -> DataFrame:
    """``(doc_id, fp)``, with the 64 bits in a long."""
    storage.prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema.names)

    return docs.select("doc_id", F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the changes that lead to the anchors within 2 bits, and how many there are; the first is nearest.

    Coordinate b of the code has the parity-check column b + 1.
    """
    changes, counts = np.zeros((CODE_LENGTH + 1, 16), np.int64), np.ones(CODE_LENGTH + 1, np.int64)
    for s in range(1, CODE_LENGTH + 1):
        found = [1 << (s - 1)]
        found += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, CODE_LENGTH + 1) if i < i ^ s]
        changes[s, : len(found)], counts[s] = found, len(found)
    return changes, counts


FLIPS, N_FLIPS = _flips()


def syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for bit in range(CODE_LENGTH):
        out ^= np.where(words >> bit & 1, bit + 1, 0)
    return out


def words_of(fps: np.ndarray) -> list[np.ndarray]:
    """The 30 bits of every triple."""
    mask = (1 << BLOCK_BITS) - 1
    blocks = [(fps.view(np.uint64) >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & mask for b in range(6)]
    return [blocks[a] | blocks[b] << BLOCK_BITS | blocks[c] << 2 * BLOCK_BITS for a, b, c in TRIPLES]


def reached(word: np.ndarray, triple: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that words of a triple visit: index of the word, anchor (with its triple), whether it is the home."""
    s = syndrome(word)
    n = N_FLIPS[s]
    at = np.repeat(np.arange(len(word)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, word[at] ^ FLIPS[s[at], nth] | np.broadcast_to(triple, word.shape)[at] << 32, nth == 0


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every visit of the fingerprints: index of the fingerprint, anchor (with its triple), whether it is the home."""
    return tuple(np.concatenate(x) for x in zip(*(reached(word, t) for t, word in enumerate(words_of(fps)))))


def _outside() -> np.ndarray:
    """By triple: masks of two of six blocks of the 34 bits outside it, for every choice of two."""
    out = []
    for triple in TRIPLES:
        inside = {b for t in triple for b in range(BLOCK_BITS * t, BLOCK_BITS * (t + 1))}
        cut = np.array_split([b for b in range(64) if b not in inside], THRESHOLD + 2)
        out.append([sum(1 << int(b) for c in chosen for b in cut[c]) for chosen in combinations(range(THRESHOLD + 2), 2)])
    return np.array(out, np.uint64)


OUTSIDE = _outside()


def split_keys(anchor: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Keys in place of a hot anchor, one row for each choice of two blocks; a clash only costs comparisons."""
    masks = OUTSIDE[anchor >> 32]
    base = anchor.view(np.uint64) * np.uint64(_FACTORS[0])
    content = (fps.view(np.uint64)[:, None] & masks) * np.uint64(_FACTORS[1])
    which = np.arange(1, masks.shape[1] + 1, dtype=np.uint64) * np.uint64(_FACTORS[2])
    mixed = (content ^ (content >> np.uint64(29))) * np.uint64(_FACTORS[2]) + which + base[:, None]
    return mixed.view(np.int64)


def hot_anchors(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Every anchor with more than ``hot`` visitors, and some with over half as many.

    Words that few fingerprints share bring an anchor at most half of ``hot``; the others are summed.
    """

    def words(batches):
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w | t << 32 for t, w in enumerate(words_of(fps))]))], ["word"])

    def visited(batches):
        for batch in batches:
            word, n = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            at, anchor, _ = reached(word & (1 << 32) - 1, word >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n[at])], ["anchor", "n"])

    shared = distinct.mapInArrow(words, "word long").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") * 2 * REACHING > hot)
    return shared.mapInArrow(visited, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * 2 > hot).select("anchor")


def _visits(distinct: DataFrame) -> DataFrame:
    schema = "anchor long, fp long, home boolean"

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(lo, 2048).to_numpy(zero_copy_only=False)
                index, keys, home = anchors(np.ascontiguousarray(fps))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[index]), pa.array(home)], ["anchor", "fp", "home"])

    return distinct.mapInArrow(run, schema)


def meetings(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """``(key, fp, home)``: rows of equal key are to be compared; the key is the anchor, or stands in for a hot one."""
    visits = _visits(distinct)
    hottest = storage.materialize(hot_anchors(distinct, hot), "hot-anchors")
    if hottest.isEmpty():
        return visits.withColumnRenamed("anchor", "key")
    marked = visits.join(hottest.select(F.col("anchor").alias("hot")), F.col("anchor") == F.col("hot"), "left").select("anchor", "fp", "home", F.col("hot").isNotNull().alias("split"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                anchor, fps, home, split = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.slice(lo, 8192).columns)
                keys = split_keys(anchor[split], fps[split])
                again = keys.shape[1]
                found = (np.concatenate((anchor[~split], keys.ravel())), np.concatenate((fps[~split], np.repeat(fps[split], again))), np.concatenate((home[~split], np.repeat(home[split], again))))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "fp", "home"])

    return marked.mapInArrow(run, "key long, fp long, home boolean")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD  # of a signed number it would count the absolute value


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of linked rows; ``root`` is each row's smallest linked one."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def _cut(n: int, varying: int) -> int:
    """Into how many blocks to cut the varying bits of ``n`` rows: with b of them pairs within the threshold agree on some
    b - THRESHOLD, for each choice of which a row is compared with those of equal content.  More blocks make more choices
    and fewer rows of equal content; the number of blocks with the least work follows the number of rows, so that the work
    of a row hardly does."""
    work = lambda b: comb(b, THRESHOLD) * (1 + n / 2 ** (varying * (b - THRESHOLD) / b))
    return min(range(THRESHOLD + 1, THRESHOLD + 9), key=work)


def _dense_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all links among many different fingerprints that meet.

    Rows that differ in one bit are joined by lookups.  Of the others, pairs within the threshold agree on some of the
    blocks that the varying bits are cut into; only rows outside the largest group so far are compared, each with
    those of equal content.  Where very many rows have one content, their other bits are cut in turn.
    """
    order = np.argsort(fps.view(np.uint64), kind="stable")
    rows = fps.view(np.uint64)[order]
    n, root = len(rows), np.arange(len(rows))
    same = np.flatnonzero(rows[1:] == rows[:-1])
    _merge(root, same, same + 1)
    varying = int(np.bitwise_or.reduce(rows ^ rows[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    for b in bits:
        low = np.flatnonzero(~rows & np.uint64(1 << b))
        other = rows[low] | np.uint64(1 << b)
        at = np.minimum(np.searchsorted(rows, other), n - 1)
        hit = rows[at] == other
        _merge(root, low[hit], at[hit])
    blocks = _cut(n, len(bits))
    masks = [sum(1 << int(b) for b in block) for block in np.array_split(np.array(bits, np.int64), blocks)]
    for chosen in combinations(masks, blocks - THRESHOLD):
        largest = np.bincount(root, minlength=n).argmax()
        if (root == largest).all():
            break
        content = rows & np.uint64(sum(chosen))
        by = np.argsort(content, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], content[by][1:] != content[by][:-1], [True])))
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        open_ = np.flatnonzero(root[by] != largest)
        crowds = np.unique(group[open_[(sizes[group[open_]] > DENSE) & (sizes[group[open_]] < n)]])
        for g in crowds.tolist():  # the bits chosen are the same in all of them, so fewer vary
            own = by[cuts[g] : cuts[g + 1]]
            a, b = _dense_links(rows[own].view(np.int64))
            _merge(root, own[a], own[b])
        few = (sizes > 1) & ~np.isin(np.arange(len(sizes)), crowds)
        open_ = open_[few[group[open_]]]
        for a, b in _pairs(open_, cuts[group[open_]], sizes[group[open_]]):
            a, b = by[a], by[b]
            near = close(rows[a].view(np.int64), rows[b].view(np.int64))
            _merge(root, a[near], b[near])
    linked = np.flatnonzero(root != np.arange(n))
    return order[linked], order[root[linked]]


def _pairs(of: np.ndarray, first: np.ndarray, width: np.ndarray):
    """Every row of ``of`` with each of the ``width`` rows from ``first`` on, some million pairs at a time."""
    total, lo = np.cumsum(width), 0
    while lo < len(of):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000)))
        w = width[lo:hi]
        a = np.repeat(of[lo:hi], w)
        yield a, np.repeat(first[lo:hi], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        lo = hi


def _meet(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole anchors, rows sorted by anchor: pairs of fingerprints that form a forest."""
    cuts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    sizes = np.diff(cuts)
    left, right = [], []
    for g in np.flatnonzero(sizes > DENSE).tolist():
        a, b = _dense_links(fps[cuts[g] : cuts[g + 1]])
        left.append(a + cuts[g])
        right.append(b + cuts[g])
    # every home row against all rows of its anchor, some million comparisons at a time
    group = np.repeat(np.arange(len(sizes)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1) & (sizes[group] <= DENSE))
    for a, b in _pairs(homes, cuts[group[homes]], sizes[group[homes]]):
        keep = (a != b) & close(fps[a], fps[b])
        left.append(a[keep])
        right.append(b[keep])
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    rows, ends = np.unique(np.concatenate((fps[a], fps[b])), return_inverse=True)
    root = local_stars(len(rows), ends[: len(a)], ends[len(a) :])
    linked = root != np.arange(len(rows))
    return rows[linked], rows[root[linked]]


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """``(a, b)``: links that join exactly the distinct fingerprints ``fp`` within the threshold of one another."""
    met = meetings(distinct, hot).repartition(storage.shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):
        held: list[list[np.ndarray]] = []  # rows of one key, which may go on
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            if held and now[0][-1] == held[0][0][0]:
                held.append(now)
                continue
            whole = int(np.searchsorted(now[0], now[0][-1]))
            yield _links(*(np.concatenate(x) for x in zip(*held, [c[:whole] for c in now])))
            held = [[c[whole:] for c in now]]
        if held:
            yield _links(*(np.concatenate(x) for x in zip(*held)))

    return met.mapInArrow(run, "a long, b long")


def _links(anchor, fps, home) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _meet(anchor, fps, home)], ["a", "b"])


def groups(docs: DataFrame, text: str = "text", shingle_words: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``: the smallest id reachable over links, itself included."""
    fps = storage.materialize(fingerprints(docs, text, shingle_words), "fingerprints", compression="zstd")
    distinct = storage.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct", compression="zstd")
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.select("fp", F.col("root").alias("__root")).join(named, F.col("__root") == F.col("root")).select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(labels, fps["fp"] == labels["__fp"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", shingle_words: int = 4) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest id, and of equal ids that of the smallest text hash.

    A row without an id comes before all others.  Of rows equal in id and text one stays.
    """
    text_hash = F.xxhash64(f"`{text}`")
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), text_hash.alias("hash")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    first = groups(keyed, "text", shingle_words).where(F.col("doc_id") == F.col("component_id"))
    kept = storage.materialize(first.groupBy(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash")).agg(F.count("*").alias("__rows")), "kept", compression="zstd")
    hashed = docs.withColumn("__own_hash", text_hash)
    found = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash")), "left_semi")
    if not kept.where("__rows > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "__own_hash"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all ``documents``."""
    found = groups(storage.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
