"""Allow and block rules over URLs, by a sort-merge range join with a stack of nested rules.

The labels of a host, reversed and each ended by a dot, make a key in which a domain and its subdomains are one interval:
all keys that begin with the domain's.  Keys of URLs and rules are dealt to range partitions by sampled split points (the
sample only balances; no result depends on it) and sorted there.  A rule goes to every partition its interval meets.  One
sweep keeps the rules whose interval holds the current key on a stack, innermost last, and picks the longest whose path
begins the URL's.  A URL that fills a third of the table is split, as split points carry a salt beside the key.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; of rules with equal host
and path a block wins; rules with a null host or path fit nothing; repeated rows are judged each, and one URL however
often it stands; very long URLs are compared whole; an empty table of URLs gives no rows, one of rules the default
verdict for all; extra columns of the input stay, unless named like an output.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

OUTPUTS = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_PER_PARTITION, SAMPLE_LIMIT = 64, 50_000
LAST = "\U0010ffff"

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Active:
    """The stack of rules whose interval holds the current key."""

    def __init__(self):
        #: Key, host, verdict by path, and the lengths that paths have in order.
        self.frames: list[tuple[str, str, dict[str, str], list[int]]] = []

    def move_to(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move_to(key)
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, host, {}, []))
        _, _, by_path, lengths = self.frames[-1]
        if by_path.get(path) != "block":
            by_path[path] = verdict
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def longest(self, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule that fits; of equal lengths the one with the longer host.

        A host's paths are looked up by their lengths, so their number does not matter.
        """
        best, found = -1, None
        for _, host, by_path, lengths in reversed(self.frames):
            # no rule of a frame is longer than its host and the whole path
            if len(host) + len(path) <= best:
                continue
            for n in reversed(lengths[: bisect_right(lengths, len(path))]):
                if path[:n] in by_path:
                    if len(host) + n > best:
                        best, found = len(host) + n, (host + path[:n], by_path[path[:n]])
                    break
        return found


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``; ``rules`` has verdict, host and path."""
    spark = urls.sparkSession
    storage.prepare(spark)
    n = partitions or storage.shuffle_partitions(spark)
    kept = [f for f in urls.schema.fields if f.name not in OUTPUTS]
    source = urls.select(*[F.col(f"`{f.name}`") for f in kept], host_of(url).alias("__host"), path_of(url).alias("__path"), F.xxhash64(F.monotonically_increasing_id()).alias("__salt"))
    keyed = source.withColumn("__key", key_of(F.col("__host")))
    # picked by a hash of the salt, as the salts themselves are to be a fair sample too
    sample = keyed.select("__key", "__salt").orderBy(F.xxhash64("__salt"), "__salt").limit(min(SAMPLE_LIMIT, SAMPLE_PER_PARTITION * n)).collect()
    sample = sorted((r[0], r[1]) for r in sample)
    splits = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []

    def deal(batches):  # URLs to the partition of their key and salt
        for batch in batches:
            keys, salts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__key", "__salt"))
            part = pa.array([bisect_right(splits, k) for k in zip(keys, salts)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], [*batch.schema.names, "__part"])

    def spread(batches):  # rules to every partition their interval meets
        for batch in batches:
            rows = []
            for verdict, host, path, key in zip(*(c.to_pylist() for c in batch.columns)):
                first, last = bisect_left(splits, (key, -(2**63))), bisect_right(splits, (key + LAST, 2**63))
                rows += [(verdict, host, path, key, part) for part in range(first, last + 1)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int32()])], ["__verdict", "__host", "__path", "__key", "__part"])

    dealt = storage.map_arrow(keyed, deal, T.StructType([*keyed.schema.fields, T.StructField("__part", T.IntegerType())])).withColumn("__verdict", F.lit(None).cast("string"))
    own = rules.where("host is not null and path is not null and verdict is not null").select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    ruled = own.withColumn("key", key_of(F.col("host"))).mapInArrow(spread, "__verdict string, __host string, __path string, __key string, __part int")
    both = dealt.drop("__salt").unionByName(ruled, allowMissingColumns=True)
    swept = both.repartitionById(n, F.col("__part")).sortWithinPartitions(F.col("__key"), F.col("__verdict").isNull())
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *[T.StructField(o, T.StringType()) for o in OUTPUTS]])

    def sweep(batches):
        active = Active()
        for batch in batches:
            at = batch.schema.get_field_index
            found, take = [], []
            for k, (key, host, path, verdict) in enumerate(zip(*(batch.column(at(c)).to_pylist() for c in ("__key", "__host", "__path", "__verdict")))):
                if verdict is not None:
                    active.add(key, host, path, verdict)
                    continue
                active.move_to(key)
                take.append(k)
                found.append((host, path, *(active.longest(path) or (None, default))))
            rows = batch.take(pa.array(take, pa.int64()))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[rows.column(at(c)) for c in names], *[pa.array(c, pa.string()) for c in columns]], schema.names)

    return storage.map_arrow(swept, sweep, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` under ``RULES``."""
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(storage.table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", *OUTPUTS)


ORACLE_SQL = """
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS n
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ranked AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rule_host || r.rule_path AS rule,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS nth
  FROM parsed p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
"""
