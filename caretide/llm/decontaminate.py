"""Benchmark decontamination: item-sized windows of documents against benchmark items, by SimHash and exact check.

Words are lower-cased runs of letters, digits and underscores; shingles are five of them.  For each size that items have
(in shingles), windows of that size slide over a document.  A window can only reach the similarity if most of its
shingles stand in the benchmark, so windows with too few of those are passed over without loss.  The others get a SimHash
fingerprint; a multi-index of Hamming blocks gives every item within the radius of it (blocks share out the radius, so one
block of a near pair is near enough to be looked up); the weighted Jaccard similarity of the shingles, each weighing its
number of occurrences, decides.  A document with fewer shingles than an item is itself the one window for it; items that
long and near enough are found exactly by the shingles that they share.  An item of fewer than five words is one shingle
of its own words, looked for in word windows of its own length.

Equal items are looked for once.  A benchmark of at most ``SENT_BYTES`` of text is sent to the tasks, a size that is measured
first.  A larger one never passes through the driver.  One pass over the documents keeps those that can match any item at
all, by a filter of fixed size over the shingles of the whole benchmark.  A match shares so many shingles with its item that it
has one of any fifth of them; the fifth that the fewest items have names an item, and a join of these shingles with those
of the documents gives every pair that can match.  Pairs are dealt to tasks by document and a part of the items, and there the
windows of the document are compared with those items as above.

Defined cases: null and empty texts and items match nothing; a document of fewer than five words matches short items that
stand in it; items of equal text all match, items of null id too; of an item's windows with equal similarity one stays, always
the same; a document row matches on its own, whatever other rows have its id, so repeated rows
give repeated results; very long texts are read whole, windows ``SLAB`` shingles at a time; empty tables
give no leaks and leave all documents; ``clean`` keeps all columns of any name, ``leaks`` has its own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from caretide.llm import storage
from caretide.llm.simhash import majority

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20  #: shingle sets of similarity 0.8 differ in about 10 of 64 bits, with a deviation of 3
SENT_BYTES = 16 << 20  #: benchmark text that may be sent to tasks
FILTER_BITS = 30  #: 2 to this power bits (128 MiB) at most tell which shingles may stand in a larger benchmark
KEY_BITS = 10  #: 2 to this power bits for each of its shingles, while there is room; each sets two
MANY_SIZES = 1000  #: above so many sizes of items the filter counts a document's shingles only
PARTS, ITEMS_AT_ONCE = 64, 256  #: parts of the items that one document is compared with; items that are ready at one time
WORDS_CACHED = 500_000
SLAB = 1 << 15  #: shingles whose bits are unpacked at once
WORDS = re.compile(r"\w+").findall


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))]


def similarity(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> float:
    """Weighted Jaccard similarity; a shingle weighs its number of occurrences."""
    shared = (Counter(a) & Counter(b)).total()
    return shared / (len(a) + len(b) - shared) if a or b else 0.0


def shingle_hash(shingle: tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(shingle).encode(), 42)


class HammingIndex:
    """All of a set of 64-bit fingerprints within ``radius`` of a query.

    The bits are cut into blocks, and the radius shared out over them: two fingerprints within it are within
    ``radius // blocks`` on some block.  Each fingerprint is listed under every value of a block that near to its own.
    """

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS, blocks: int = 7):
        self.fingerprints, self.radius = fingerprints.astype(np.uint64), radius
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        near, starts, items = radius // blocks, [], []
        self.low, self.mask, self.at = np.array(cuts[:-1], np.uint64), [], []
        for lo, hi in zip(cuts, cuts[1:]):
            width = hi - lo
            masks = np.array([sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(width), n)], np.int64)
            own = (self.fingerprints >> np.uint64(lo)).astype(np.int64) & ((1 << width) - 1)
            keys = (own[:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            self.mask.append((1 << width) - 1)
            self.at.append(sum(map(len, starts)))
            starts.append(np.searchsorted(keys[order], np.arange((1 << width) + 1)) + sum(map(len, items)))
            items.append(np.repeat(np.arange(len(own), dtype=np.int32), len(masks))[order])
        # all blocks end to end, so that a query looks into them in one go
        self.mask, self.at, self.starts, self.items = np.array(self.mask, np.uint64), np.array(self.at), np.concatenate(starts), np.concatenate(items)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's and a fingerprint's index, in order."""
        value = (((queries[:, None] >> self.low) & self.mask).astype(np.int64) + self.at).ravel()
        first = self.starts[value]
        counts = self.starts[value + 1] - first
        total = int(counts.sum())
        query = np.repeat(np.arange(len(value)) // len(self.at), counts)
        item = self.items[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(total)]
        near = np.bitwise_count(self.fingerprints[item] ^ queries[query]) <= self.radius
        return np.divmod(np.unique(query[near] * len(self.fingerprints) + item[near]), max(1, len(self.fingerprints)))


class Benchmark:
    """Some items, ready to be looked for."""

    #: Odd multipliers of a shingle's word numbers; a clash only costs an exact check.
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

    def __init__(self, items: list[tuple[object, str]]):
        self.ids: list[object] = []
        self.words: list[np.ndarray] = []  # numbers of the words of each item
        self.short: dict[str, dict[tuple[str, ...], list[object]]] = {}  # by first word, items of fewer words than a shingle
        self.number: dict[str, int] = {}
        fingerprints, keys, holders = [], [], []
        for item, text in items:
            words = WORDS((text or "").lower())
            if not words:
                continue
            if len(words) < SHINGLE:
                self.short.setdefault(words[0], {}).setdefault(tuple(words), []).append(item)
                continue
            numbers = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
            own = np.unique(self._key(np.lib.stride_tricks.sliding_window_view(numbers, SHINGLE)))
            keys.append(own)
            holders.append(np.full(len(own), len(self.ids), np.int32))
            fingerprints.append(majority(np.array([shingle_hash(s) for s in shingles_of(words)], np.uint64)))
            self.ids.append(item)
            self.words.append(numbers)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.holders = self.keys[order], np.concatenate(holders)[order] if holders else np.zeros(0, np.int32)
        self.size_of = np.array([len(w) - SHINGLE + 1 for w in self.words], np.int64)
        self.sizes = np.unique(self.size_of).tolist()
        prints = np.array(fingerprints, np.uint64)
        #: For each size the items of it and the index of their fingerprints.
        self.index = {n: (own, HammingIndex(prints[own])) for n in self.sizes for own in (np.flatnonzero(self.size_of == n),)}

    def _similarity(self, numbers: list[int], item: int) -> float:
        """Of the words with these numbers and the item; words of no item are -1 and never in one."""
        sides = (numbers, self.words[item].tolist())
        return similarity(*([*zip(*(side[k:] for k in range(SHINGLE)))] for side in sides))

    def _key(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(np.uint64) + np.uint64(1)) * self.FACTORS).sum(axis=1, dtype=np.uint64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each five-word shingle stands in the benchmark, and the keys of those that do."""
        n = len(numbers) - SHINGLE + 1
        full = numbers[:n] >= 0
        for k in range(1, SHINGLE):
            full &= numbers[k : n + k] >= 0
        at = np.flatnonzero(full)
        out, keys = np.zeros(n, bool), np.zeros(0, np.uint64)
        if len(at):
            keys = self._key(numbers[at[:, None] + np.arange(SHINGLE)])
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[at] = self.keys[place] == keys
            keys = keys[out[at]]
        return out, keys

    def _short(self, words: list[str]) -> dict[object, tuple[int, int]]:
        """Items of fewer than five words that stand in the text: first word and number of words."""
        found: dict[object, tuple[int, int]] = {}
        for at in [k for k, w in enumerate(words) if w in self.short]:
            for item, ids in self.short[words[at]].items():
                if tuple(words[at : at + len(item)]) == item:
                    for i in ids:
                        found.setdefault(i, (at, len(item)))
        return found

    def longer(self, numbers: np.ndarray, keys: np.ndarray) -> list[tuple[int, float]]:
        """Items with more shingles than the whole document, and their similarity to it; ``keys`` are of its hits."""
        n = len(numbers) - SHINGLE + 1
        at = bisect_right(self.sizes, n)
        if at == len(self.sizes) or n < SIMILARITY * self.sizes[at] - 1e-9:
            return []
        # shared / (n + size - shared) >= SIMILARITY, for the smallest of the sizes
        least = math.ceil((n + self.sizes[at]) * SIMILARITY / (1 + SIMILARITY) - 1e-9)
        if len(keys) < least:
            return []
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        # an item that shares so many has one of any len(keys) - least + 1: those that the fewest items have
        rare = np.argsort(hi - lo, kind="stable")[: len(keys) - least + 1]
        items = np.unique(np.concatenate([self.holders[lo[k] : hi[k]] for k in rare.tolist()]))
        items = items[(self.size_of[items] > n) & (self.size_of[items] * SIMILARITY <= n + 1e-9)]
        own = numbers.tolist()
        found = [(i, self._similarity(own, i)) for i in items.tolist()]
        return [(i, s) for i, s in found if s >= SIMILARITY - 1e-12]

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)``: the best window of each item that the text holds."""
        words = WORDS((text or "").lower())
        short = [(item, at, n, 1.0) for item, (at, n) in self._short(words).items()] if self.short else []
        if len(words) < SHINGLE or not self.ids or first_only and short:
            return short
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        hit, keys = self.hits(numbers)
        if not len(keys):
            return short
        best: dict[int, tuple[float, int, int]] = {i: (found, 0, len(hit)) for i, found in self.longer(numbers, keys)}
        windows = enough(hit, self.sizes)
        if windows and not (first_only and best):
            listed = numbers.tolist()
            for n, at, fingerprints in self._fingerprints(words, windows):
                own, index = self.index[n]
                window, item = index.within(fingerprints)
                # nearest fingerprints first: an item that is found as it stands needs no other window
                order = np.argsort(np.bitwise_count(fingerprints[window] ^ index.fingerprints[item]), kind="stable")
                for first, i in zip(at[window[order]].tolist(), own[item[order]].tolist()):
                    before = best.get(i, (0.0, 0, 0))[0]
                    if before == 1.0:
                        continue
                    found = self._similarity(listed[first : first + n + SHINGLE - 1], i)
                    if found >= SIMILARITY - 1e-12 and found > before:
                        best[i] = (found, first, n)
                if first_only and best:
                    break
        return short + [(self.ids[i], first, min(n + SHINGLE - 1, len(words)), found) for i, (found, first, n) in sorted(best.items())]

    def _fingerprints(self, words: list[str], windows: list[tuple[int, np.ndarray]]):
        """SimHash of every window, from running sums of the bits of its shingles: size, first words, fingerprints."""
        low = min(int(a[0]) for _, a in windows)
        high = max(int(a[-1]) + n for n, a in windows)
        edges = np.zeros(high - low + 1, np.int32)
        for n, a in windows:
            np.add.at(edges, a - low, 1)
            np.add.at(edges, a - low + n, -1)
        covered = np.cumsum(edges[:-1]) > 0
        needed, rank = np.flatnonzero(covered), np.cumsum(covered) - covered  # only covered shingles take room
        hashes = np.array([shingle_hash(tuple(words[k + low : k + low + SHINGLE])) for k in needed.tolist()], "<u8")
        for n, a in windows:
            places, lo = rank[a - low], 0
            while lo < len(a):
                hi = max(lo + 1, int(np.searchsorted(places, places[lo] + SLAB)))
                at = places[lo:hi] - places[lo]
                bits = np.unpackbits(hashes[places[lo] : places[hi - 1] + n].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.zeros((len(bits) + 1, 64), np.int32)
                np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
                packed = np.packbits((sums[at + n] - sums[at]) * 2 > n, axis=1, bitorder="little")
                yield n, a[lo:hi], np.ascontiguousarray(packed).view("<u8").ravel()
                lo = hi


def enough(hit: np.ndarray, sizes: list[int]) -> list[tuple[int, np.ndarray]]:
    """Window sizes, and where windows of that size begin that hold enough shingles of the benchmark."""
    counts, windows = np.concatenate(([0], np.cumsum(hit))), []
    for size in sizes:
        # shared / (2 size - shared) >= SIMILARITY
        least = math.ceil(2 * size * SIMILARITY / (1 + SIMILARITY) - 1e-9)
        if least <= counts[-1] and size <= len(hit):
            at = np.flatnonzero(counts[size:] - counts[:-size] >= least)
            if len(at):
                windows.append((size, at))
    return windows


def grams(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """A hash of every run of ``n`` words, five at most."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if len(known) > WORDS_CACHED:
        known.clear()
    known.update((w, xxhash.xxh64_intdigest(w.encode(), 42)) for w in set(words).difference(known))
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return (np.lib.stride_tricks.sliding_window_view(hashes, n) * Benchmark.FACTORS[:n]).sum(axis=1, dtype=np.uint64) + np.uint64(SHINGLE - n)


class ShingleFilter:
    """Which documents can match any item of a benchmark of any size: a set of hashed shingles in a bounded number of bits.

    A clash lets a document pass that the exact comparison turns down; none is lost.
    """

    def __init__(self, bits: np.ndarray, sizes: list[int], short: list[int]):
        self.bits, self.sizes, self.short = bits, sizes, short
        self.width = np.uint64(len(bits) * 8 - 1)
        self.known: dict[str, int] = {}

    def holds(self, keys: np.ndarray) -> np.ndarray:
        both = [at & self.width for at in (keys >> np.uint64(20), keys ^ keys >> np.uint64(33))]
        found = [self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in both]
        return (found[0] & found[1]).astype(bool)

    def keys(self, text: str | None) -> np.ndarray:
        """All runs of words of the text that the filter holds, once each."""
        words = WORDS((text or "").lower())
        own = np.unique(np.concatenate([grams(words, n, self.known) for n in (*self.short, SHINGLE)]))
        return own[self.holds(own)]

    def may_match(self, text: str | None) -> bool:
        words = WORDS((text or "").lower())
        if any(self.holds(grams(words, n, self.known)).any() for n in self.short):
            return True
        if len(words) < SHINGLE or not self.sizes:
            return False
        hit = self.holds(grams(words, SHINGLE, self.known))
        if not hit.any():
            return False
        if len(self.sizes) > MANY_SIZES:
            return bool(hit.sum() >= min(self.sizes[0], len(hit)) * 2 * SIMILARITY / (1 + SIMILARITY) - 1e-9)
        # a document shorter than an item has to share almost all of its shingles
        longer = bisect_right(self.sizes, len(hit)) < len(self.sizes) and hit.sum() >= 2 * len(hit) * SIMILARITY / (1 + SIMILARITY) - 1e-9
        return bool(longer or enough(hit, self.sizes))


def item_keys(items: DataFrame) -> DataFrame:
    """``(item, key, copies, size, words)``: every shingle of every item, how often it stands there, and the number of the
    item's shingles; an item of fewer than five words is one run of its own ``words``."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for item, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                words = WORDS((text or "").lower())
                if not words:
                    continue
                n = min(SHINGLE, len(words))
                keys, copies = np.unique(grams(words, n, known), return_counts=True)
                size = len(words) - n + 1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(copies.astype(np.int64)), pa.array(np.full(len(keys), size)), pa.array(np.full(len(keys), n))], ["item", "key", "copies", "size", "words"])

    return storage.materialize(items.select("item_id", "text").mapInArrow(run, "item string, key long, copies long, size long, words long"), "shingles", compression="zstd")


def shingle_filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> ShingleFilter:
    """Of ``item_keys``; the driver gets the parts of the bit set that are not zero, never more than the set has."""
    bits = min(most_bits, max(12, keys.count().bit_length() + KEY_BITS))
    at = keys.select(F.explode(F.expr("array(shiftrightunsigned(key, 20), key ^ shiftrightunsigned(key, 33))")).alias("at")).select(F.expr(f"at & {(1 << bits) - 1}L AS at"))
    words = at.select(F.shiftrightunsigned("at", 6).alias("place"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    out = np.zeros((1 << bits) >> 6, np.uint64)
    for batch in words.groupBy("place").agg(F.bit_or("bit").alias("bit")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    sizes = [r[0] for r in keys.where(F.col("words") == SHINGLE).select("size").distinct().orderBy("size").limit(MANY_SIZES + 1).collect()]
    short = sorted(r[0] for r in keys.where(F.col("words") < SHINGLE).select("words").distinct().collect())
    return ShingleFilter(out.view(np.uint8), sizes, short)


def telling_keys(keys: DataFrame) -> DataFrame:
    """``(key, item)``: for each item shingles of which whatever matches it has one.

    A window of the item's size shares 16/18 of its shingles, a whole document that is shorter 4/5 at least.  So one of any
    fifth, and one more, is shared; those that the fewest items have are taken, repeats counted.
    """
    counts = storage.materialize(keys.groupBy("key").agg(F.count("*").alias("__items")).withColumnRenamed("key", "__key"), "item-counts", compression="zstd")
    counted = keys.join(counts, F.col("key") == F.col("__key"))
    so_far = F.sum("copies").over(Window.partitionBy("item").orderBy("__items", "key").rowsBetween(Window.unboundedPreceding, -1))
    take = F.col("size") - F.ceil(F.col("size") * SIMILARITY - F.lit(1e-9)) + 1
    return counted.withColumn("__before", F.coalesce(so_far, F.lit(0))).where(F.col("__before") < take).select("key", "item")


@lru_cache(maxsize=1)
def _prepared(items: tuple[tuple[object, str], ...]) -> Benchmark:
    return Benchmark(list(items))


def _distinct(benchmark: DataFrame) -> DataFrame:
    """``(item_id, text)`` with every text once, named by its digest; copies of an item take no room."""
    return storage.materialize(benchmark.where("text is not null").select("text").distinct().select(F.sha2("text", 256).alias("item_id"), "text"), "items", compression="zstd")


def _sent(items: DataFrame) -> tuple[tuple[str, str], ...]:
    """All of a benchmark whose bytes have been found to be few."""
    return tuple((r.item_id, r.text) for r in items.orderBy("item_id").collect())


def _bytes(items: DataFrame) -> int:
    return int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def _sifted(docs: DataFrame, sieve: Broadcast, text: str, able: bool) -> DataFrame:
    """Documents that may match, or those that cannot."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sieve.value.may_match(t) == able for t in batch.column(at).to_pylist()], pa.bool_()))

    return storage.map_arrow(docs, run, docs.schema)


class _Sifted:
    """Documents that can match an item of a large benchmark, numbered, and the pairs of them and items that can match."""

    def __init__(self, docs: DataFrame, items: DataFrame, text: str):
        spark = docs.sparkSession
        keys = item_keys(items)
        self.items, self.text, self.sieve = items, text, spark.sparkContext.broadcast(shingle_filter(keys))
        able = _sifted(docs, self.sieve, text, True).withColumn("__row", F.monotonically_increasing_id())
        self.able = storage.materialize(able, "able", compression="zstd")
        sieve = self.sieve

        def run(batches):
            for batch in batches:
                for row, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                    found = sieve.value.keys(text)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(found.view(np.int64))], ["row", "key"])

        own = self.able.select("__row", F.col(f"`{text}`").alias("__text")).mapInArrow(run, "row long, key long")
        telling = storage.materialize(telling_keys(keys), "telling", compression="zstd")
        part = F.pmod(F.xxhash64("item"), F.lit(PARTS)).cast("int").alias("part")
        self.pairs = storage.materialize(own.join(telling, "key").select("row", "item").distinct().select("row", part, "item"), "pairs", compression="zstd")

    def matches(self, first_only: bool) -> DataFrame:
        """``(row, item, first_word, n_words, similarity)``.  A task has one document's text and some of its items at a time."""
        texts = self.items.select(F.col("item_id").alias("item"), F.col("text").alias("content"))
        with_items = self.pairs.join(texts, "item").select("row", "part", F.lit(1).alias("kind"), "item", "content")
        own = self.able.select(F.col("__row").alias("row"), F.col(f"`{self.text}`").alias("content"))
        with_text = self.pairs.select("row", "part").distinct().join(own, "row").select("row", "part", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("item"), "content")
        dealt = with_items.unionByName(with_text).repartition(storage.shuffle_partitions(self.items.sparkSession), "row", "part").sortWithinPartitions("row", "part", "kind")

        def compared(row, text, items):
            return [(row, *m) for m in Benchmark(items).matches(text, first_only)] if items else []

        def run(batches):
            row, text, items = None, None, []
            for batch in batches:
                out = []
                for now, kind, item, content in zip(*(batch.column(c).to_pylist() for c in ("row", "kind", "item", "content"))):
                    if kind == 0:
                        out += compared(row, text, items)
                        row, text, items = now, content, []
                    else:
                        items.append((item, content))
                        if len(items) == ITEMS_AT_ONCE:
                            out += compared(row, text, items)
                            items = []
                yield _found(out)
            yield _found(compared(row, text, items))

        return dealt.mapInArrow(run, "row long, item string, first_word long, n_words long, similarity double")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "item": pa.string(), "first_word": pa.int64(), "n_words": pa.int64(), "similarity": pa.float64()}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def leaks(docs: DataFrame, benchmark: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, similarity)``: for each document row and item, the best window."""
    storage.prepare(docs.sparkSession)
    items = _distinct(benchmark)
    docs = docs.select("doc_id", "text")
    if _bytes(items) > sent_bytes:
        sifted = _Sifted(docs, items, "text")
        own = sifted.able.select("doc_id", F.col("__row").alias("row"))
        out = sifted.matches(False).join(own, "row").withColumnRenamed("item", "__item")
    else:
        ready = _sent(items)
        schema = T.StructType([docs.schema["doc_id"], T.StructField("__item", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])

        def run(batches):
            block = _prepared(ready)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in block.matches(t)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

        out = docs.mapInArrow(run, schema)
    named = benchmark.where("text is not null").select("item_id", F.sha2("text", 256).alias("__item"))
    return out.join(named, "__item").select("doc_id", "item_id", "first_word", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    With a large benchmark, the rows that the filter lets through are stored, numbered and compared; those that cannot match
    are read once more and stay.
    """
    storage.prepare(docs.sparkSession)
    items = _distinct(benchmark)
    if _bytes(items) <= sent_bytes:
        return _without(docs, _sent(items), text)
    sifted = _Sifted(docs, items, text)
    held = storage.materialize(sifted.matches(True).select("row").distinct(), "held", compression="zstd")
    kept = sifted.able.join(held, F.col("__row") == F.col("row"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return _sifted(docs, sifted.sieve, text, False).union(kept)


def _without(docs: DataFrame, items: tuple[tuple[str, str], ...], text: str) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches):
        ready = _prepared(items)
        for batch in batches:
            yield batch.filter(pa.array([not ready.matches(t, first_only=True) for t in batch.column(at).to_pylist()], pa.bool_()))

    return storage.map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``, and which."""
    return leaks(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))
