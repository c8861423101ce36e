"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme values.

Training, on a bounded sample of labelled rows (``Settings.rows_per_class``): document counts of words, and of word
beginnings shared by several words, give log-odds of toxic against clean with an informative Dirichlet prior (the prior
of a token is ``Settings.prior_share`` of its own count, spread as in the whole sample).  Tokens whose log-odds are significant keep them
as scores; every other word scores a small negative drift.

Scoring: one linear scan finds all maximal scoring segments of a text.  The chance that clean text of n words holds a
segment of score s or more is 1 - exp(-K n exp(-lambda s)); lambda solves the scores' moment equation under clean
frequencies and K comes from the clean texts of the sample.  The negative logs of a text's segments, together
and the largest alone, and its strongest token go through a logistic curve fitted on the sample: a score from 0 to 1.

Defined cases: a null or empty text scores as a text without toxic segments; very long texts are read whole, in linear
time.  Without labelled rows of both classes (an empty table among others) no token is significant and every text scores
0.  Rows of one id and different texts all count as labelled, within the bound of the sample; equal texts of one class
count once.  Segments that tie are all kept; equal texts score the same.  A column named as the result gives way to it,
other columns of any name stay.  Labels, language, source and id are never read by the scorer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

WORDS = re.compile(r"[^\W\d_]+").findall
CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 8_000  #: labelled rows that training reads at most, for each class; picked by a hash of the id
    prefixes: tuple[int, ...] = (4, 5, 6)
    min_words: int = 4  #: different words that a beginning must have in toxic texts
    prior_share: float = 0.3
    min_z: float = 3.0
    drift: float = 0.5
    threshold: float = 0.7


@dataclass
class Model:
    #: score of a token, and the negative log of its share of clean text
    words: dict[str, tuple[float, float]] = field(default_factory=dict)
    starts: dict[str, tuple[float, float]] = field(default_factory=dict)
    drift: float = 0.25
    rate: float = 1.0  #: lambda
    scale: float = 1e-6  #: K
    weights: tuple[float, ...] = ()  #: of the evidence, then the intercept
    prefixes: tuple[int, ...] = (4, 5, 6)

    def evidence(self, segments: list[float], n: int, top: float) -> tuple[float, float, float]:
        """Of a text of n words: how rare its segments are together and the rarest alone, and its rarest scoring token.

        Each counts the negative log of the number of such segments or tokens expected in clean text of n words.
        """
        rare = [max(0.0, self.rate * s - math.log(self.scale * n)) for s in segments]
        return math.log1p(sum(rare)), max(rare, default=0.0), max(0.0, top - math.log(n)) if rare else 0.0

    def probability(self, evidence: tuple[float, float, float]) -> float:
        if not self.weights:
            return 0.0
        z = sum(w * e for w, e in zip(self.weights, (*evidence, 1.0)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def word_score(self, word: str) -> tuple[float, float]:
        """Score and rarity of the word itself, else of its longest scored beginning, else zeros."""
        if word in self.words:
            return self.words[word]
        for n in sorted(self.prefixes, reverse=True):
            if len(word) > n and word[:n] in self.starts:
                return self.starts[word[:n]]
        return 0.0, 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[float, float]] = {}

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int, float]:
        """Maximal scoring segments as (first word, last word + 1, score), the number of words, the rarest scoring word."""
        words = WORDS((text or "").lower())
        known = self.known
        missing = set(words).difference(known)
        known.update((w, self.model.word_score(w)) for w in missing)
        found = [known[w] for w in words]
        if len(known) > CACHE_WORDS:
            self.known = {}
        top = max((r for _, r in set(found)), default=0.0)
        return maximal_segments([s for s, _ in found], self.model.drift) if top > 0 else [], len(words), top

    def score(self, text: str | None) -> float:
        found, n, top = self.segments(text)
        return self.model.probability(self.model.evidence([s for _, _, s in found], n, top))


def maximal_segments(scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time; words that score 0 count ``-drift``.

    Candidates stand on a stack, each with the running sums before and after it and the place of its nearest candidate
    that starts from a lower sum.  A new one is joined to its own nearest such candidate if that makes a better segment
    than either alone.  The search follows the places kept, so what it has passed over once is never visited again.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, place of the lower one
    total, last = 0.0, 0
    for at in [i for i, s in enumerate(scores) if s > 0]:
        total -= drift * (at - last)
        first, before = at, total
        total += scores[at]
        last = at + 1
        back = len(stack) - 1
        while True:
            while back >= 0 and stack[back][2] >= before:
                back = stack[back][4]
            if back < 0 or stack[back][3] >= total:
                stack.append((first, last, before, total, back))
                break
            first, _, before, _, lower = stack[back]
            del stack[back:]
            back = lower
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def labelled_fold(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``(text, toxic)`` of the sample: rows outside the held-out third, a bounded number of each class."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    picked = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows_per_class) for c in (True, False)]
    sample = picked[0].unionByName(picked[1])  # 2 * rows_per_class rows at most: that bounds the broadcast
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id").select("text", "toxic")


#: Odd multipliers, each of which orders shingles in another way.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _without_near_copies(sample: DataFrame, rows_per_class: int) -> DataFrame:
    """At most ``rows_per_class`` texts of each class, less texts that share the least of their five-word shingles, in one of four orders, with another.

    A word that only copies of one toxic text have in common would look toxic by itself.  Of such texts the one with
    the smallest hash stays.  An id may have many texts, so the bound is set anew here: the texts of the smallest hashes
    stay, and only hashes within it are grouped, broadcast or brought to the driver later.
    """
    names = [f"m{k}" for k in range(len(ORDERS))]

    def mark(batches):
        for batch in batches:
            least = []
            for text in batch.column(0).to_pylist():
                words = WORDS(text.lower())
                shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
                hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64)
                least.append((hashes[:, None] * ORDERS).min(axis=0).view(np.int64))
            marks = np.array(least).reshape(-1, len(ORDERS))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), *[pa.array(marks[:, k]) for k in range(len(ORDERS))]], ["hash", "toxic", *names])

    hashed = storage.materialize(sample.withColumn("hash", F.xxhash64("text")).dropDuplicates(["hash", "toxic"]), "toxicity-texts", compression="zstd")
    bounded = [hashed.where(F.col("toxic") == c).select("hash", "toxic").orderBy("hash").limit(rows_per_class) for c in (True, False)]
    hashed = hashed.join(F.broadcast(bounded[0].unionByName(bounded[1])), ["hash", "toxic"], "left_semi").select(*hashed.columns)
    kept = hashed.mapInArrow(mark, "hash long, toxic boolean, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        kept = kept.groupBy("toxic", name).agg(F.min_by(F.struct("hash", *names), "hash").alias("first")).select("toxic", "first.*")
    return hashed.join(F.broadcast(kept.select("hash", "toxic")), ["hash", "toxic"], "left_semi").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    spark = docs.sparkSession
    storage.prepare(spark)
    model = Model(drift=settings.drift, prefixes=settings.prefixes)
    sample = storage.materialize(_without_near_copies(labelled_fold(docs, labels, settings), settings.rows_per_class), "toxicity-sample", compression="zstd")

    def count(batches):
        for batch in batches:
            totals: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[toxic].update(set(WORDS(text.lower())))
            words = list(totals[True].keys() | totals[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([totals[c][w] for w in words], pa.int64()) for c in (True, False))], ["word", "t", "c"])

    counts = storage.materialize(sample.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-words", compression="zstd")
    toxic_sum, clean_sum = counts.agg(F.sum("t"), F.sum("c")).first()
    if not toxic_sum or not clean_sum:
        return model
    starts = counts.select(F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in settings.prefixes])).alias("word"), "t", "c").where("word is not null")
    starts = starts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("kinds")).where(F.col("kinds") >= settings.min_words)
    for tokens, found in ((model.words, counts), (model.starts, starts)):
        tokens.update((word, (odds, -math.log(share))) for word, odds, share in _significant(found, toxic_sum, clean_sum, settings).collect())
    tokens = [*model.words.values(), *model.starts.values()]
    scores = [s for s, _ in tokens]
    _moments(model, np.array(scores), np.exp([-r for _, r in tokens]))
    rows = _measured(sample, model).collect()  # two classes of at most rows_per_class texts
    _extreme_values(model, [(max(r[0], default=0.0), r[1]) for r in rows if not r[3]], min(scores, default=1.0))
    _logistic(model, np.array([model.evidence(r[0], r[1], r[2]) for r in rows]), np.array([float(r[3]) for r in rows]))
    return model


def _measured(sample: DataFrame, model: Model) -> DataFrame:
    """Segment scores, words and rarest scoring word of every text of the sample."""

    def measure(batches):
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.segments(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[s for _, _, s in g[0]] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), batch.column(1)], ["segments", "n", "top", "toxic"])

    return sample.mapInArrow(measure, "segments array<double>, n long, top double, toxic boolean")


def _significant(counts: DataFrame, toxic_sum: int, clean_sum: int, settings: Settings) -> DataFrame:
    """``(word, score, clean share)`` where the log-odds under the prior lie ``min_z`` standard deviations above 0.

    The score itself takes a flat prior of half a document, so that a word never seen in clean text stands out.
    """
    prior = settings.prior_share * (toxic_sum + clean_sum)
    own = settings.prior_share * (F.col("t") + F.col("c"))
    t, c = F.col("t") + own, F.col("c") + own
    odds = F.log(t / (toxic_sum + prior - t)) - F.log(c / (clean_sum + prior - c))
    flat = F.log((F.col("t") + 0.5) / (toxic_sum + 1.0)) - F.log((F.col("c") + 0.5) / (clean_sum + 1.0))
    scored = counts.where((F.col("t") >= 3) & (F.col("t") < toxic_sum)).select("word", odds.alias("odds"), F.sqrt(1 / t + 1 / c).alias("sd"), flat.alias("score"), ((F.col("c") + 0.5) / (clean_sum + 1.0)).alias("share"))
    return scored.where((F.col("odds") >= settings.min_z * F.col("sd")) & (F.col("score") > 0)).select("word", "score", "share")


def _moments(model: Model, scores: np.ndarray, shares: np.ndarray) -> None:
    """Set the drift so that clean text scores below 0 on average, and solve the moment equation for lambda."""
    if not len(scores):
        return
    total = float(min(shares.sum(), 0.5))
    shares = shares * (total / shares.sum())
    model.drift = max(model.drift, 2 * float(shares @ scores) / (1 - total))
    moment = lambda rate: float(shares @ np.exp(rate * scores)) + (1 - total) * math.exp(-rate * model.drift) - 1
    low, high = 1e-3, 1.0
    while moment(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    model.rate = (low + high) / 2


def _extreme_values(model: Model, clean: list[tuple[float, int]], least: float) -> None:
    """K, and lambda where enough clean texts hold a segment, by maximum likelihood of their best segments.

    A text without a segment is known to have none of the least token score or more.
    """
    best = np.array([b for b, _ in clean])
    n = np.array([max(1, w) for _, w in clean], float)
    hit = best > 0
    spread = lambda rate: float((n * np.exp(-rate * np.where(hit, best, least))).sum())
    if hit.sum() >= 20:
        rates = np.geomspace(0.05, 8, 200)
        likelihood = [math.log(r) - math.log(spread(r)) - r * best[hit].mean() for r in rates]
        model.rate = float(rates[int(np.argmax(likelihood))])
    model.scale = (float(hit.sum()) + 0.5) / max(spread(model.rate), 1e-300)


def _logistic(model: Model, evidence: np.ndarray, toxic: np.ndarray) -> None:
    """Weights by Newton's method with a weak pull to 0; targets smoothed by the class sizes."""
    up, down = toxic.sum(), len(toxic) - toxic.sum()
    if not up or not down:
        return
    target = np.where(toxic > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = np.append(np.maximum(evidence.std(axis=0), 1e-9), 1.0)
    design = np.column_stack((evidence, np.ones(len(evidence)))) / spread
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - target) + 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple((w / spread).tolist())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the column ``into``; one of that name in ``docs`` gives way."""
    storage.prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.DoubleType())])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = pa.array([scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema.names)

    return storage.map_arrow(source, run, schema)


def passages(docs: DataFrame, model: Model, max_expected: float = 1e-3) -> DataFrame:
    """``(doc_id, first_word, end_word, segment_score, expected)``: every segment rarer in clean text than the limit."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("segment_score", T.DoubleType()), T.StructField("expected", T.DoubleType())])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n, _ = scorer.segments(text)
                rows += [(i, a, b, s, e) for a, b, s in found if (e := model.scale * n * math.exp(-model.rate * s)) <= max_expected]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, scored by a model of the labelled rows outside the held-out third."""
    docs, settings = storage.table(spark, sf_dir, "documents"), Settings()
    model = train(docs, storage.table(spark, sf_dir, "labels"), settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
