"""Byte-level BPE encoding and decoding by merge replay over the vocabulary of pieces.

Replay: different pieces lie end to end in one symbol array with linked neighbours.  An inverted index leads from each
mergeable token pair, named by the rank of its merge, to the positions where it stands.  Merges are applied in rank order,
each to all its positions at once, and only the touched neighbours are looked up again.  Pieces never influence one
another, so any division of the vocabulary gives the ids that one replay over all of it would give.

``encode`` replays the vocabulary of one block of texts (of bounded size) after the other within a task, and keeps pieces
met before in a cache of bounded size: nothing is shuffled or stored.

``encode_by_corpus`` replays each piece of the corpus once, in three steps with a shuffle between each.  1: texts become
arrays of numbers, each text's pieces by their place in their block's list of different pieces; arrays and lists are stored in
the shared folder.  2: the lists are dealt by piece, so that a piece lies in one partition however many blocks have it, and
replayed.  3: the ids go back to their blocks, and one gather for each text turns numbers into ids.  A piece that every block
has is listed once a block, so nothing grows with a piece's occurrences.  Where a sixth of all pieces are new to their block
this costs more than it saves (README).

Defined cases: a null or empty text has no ids; decoding ids gives back exactly the UTF-8 bytes of the text; very long
texts are cut whole, a block ends after one; repeated rows, equal texts and rows of equal or null ids each give their own row
with the same ids; an empty table gives no rows; a column with the name of an output gives way to it, columns of any
other name stay.  Vocabularies of 65,535 ids or more are an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

NONE = np.int32(2**31 - 1)
BOUNDARY = np.int64(65535)
CACHE_PIECES = 400_000
ID = np.dtype("<u4")
IDS_AT_ONCE = 1 << 16  #: ids that are written out in one go


class Spelling:
    """What each id stands for, written out for many ids at once."""

    def __init__(self, of: list[bytes]):
        self.flat, self.size = np.frombuffer(b"".join(of), np.uint8), np.array([len(x) for x in of], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at].tobytes(), ends

    def hashed(self, coded: list[bytes], trim: int = 0) -> list[str]:
        """SHA-256 of what each text's ids stand for, less the last ``trim`` bytes; ``IDS_AT_ONCE`` ids in hand at most."""
        out, lo = [], 0
        while lo < len(coded):
            hi, n = lo, 0
            while hi < len(coded) and (hi == lo or n + len(coded[hi]) // 4 <= IDS_AT_ONCE):
                n += len(coded[hi]) // 4
                hi += 1
            if n > IDS_AT_ONCE:  # one long text
                sha, ids = hashlib.sha256(), np.frombuffer(coded[lo], ID)
                for k in range(0, n, IDS_AT_ONCE):
                    data, _ = self.write(ids[k : k + IDS_AT_ONCE])
                    sha.update(data[: len(data) - trim] if k + IDS_AT_ONCE >= n else data)
                out.append(sha.hexdigest())
            else:
                data, ends = self.write(np.frombuffer(b"".join(coded[lo:hi]), ID))
                view, stops = memoryview(data), np.concatenate(([0], ends))[np.cumsum([0, *(len(c) // 4 for c in coded[lo:hi])])].tolist()
                out += [hashlib.sha256(view[a : max(a, b - trim)]).hexdigest() for a, b in zip(stops, stops[1:])]
            lo = hi
        return out


class MergeTable:
    """Ranks of a vocabulary and the lookup from neighbouring ids to the rank of their merge.

    Ids must be below 65,535, so that a pair of them fits the index key.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.piece_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.piece_of[rank] = piece
        if len(self.piece_of) >= BOUNDARY:
            raise ValueError("vocabularies of 65,535 ids or more need wider pair keys")
        self.bytes_of, self.decimal_of = Spelling(self.piece_of), Spelling([b"%d," % i for i in range(len(self.piece_of))])
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        self.pair_rank = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.values = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), NONE)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_one(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first: the definition that replay must meet."""
        ids = [int(self.of_byte[b]) for b in piece]
        while len(ids) > 1:
            found = [self.pair_rank.get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
            rank = min(found)
            if rank == NONE:
                break
            at = found.index(rank)
            ids[at : at + 2] = [int(rank)]
        return ids

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        symbol = self.of_byte[flat]
        ends = first + sizes
        symbol[ends] = BOUNDARY
        n = len(symbol)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        rank_at = np.full(n, NONE, np.int32)
        rank_at[:-1] = self.lookup(symbol[:-1], symbol[1:])
        alive = np.ones(n, bool)
        alive[ends] = False
        chosen = np.zeros(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def note(positions: np.ndarray) -> None:
            ranks = rank_at[positions]
            keep = ranks != NONE
            positions, ranks = positions[keep], ranks[keep]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for lo, hi in zip(starts, starts[1:]):
                rank = int(ranks[lo])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(positions[lo:hi])

        note(np.flatnonzero(rank_at != NONE))
        irregular: set[int] = set()
        while waiting:
            rank = heapq.heappop(waiting)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank_at[at] == rank]
            if len(lists) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            chosen[at] = True
            if chosen[after[at]].any():  # overlapping places: the left one of two is merged
                for p in np.sort(at).tolist():
                    if chosen[p]:
                        chosen[after[p]] = False
                taken = at[chosen[at]]
                chosen[at] = False
                at = taken
            else:
                chosen[at] = False
            gone = after[at]
            beyond = after[gone]
            symbol[at] = rank
            after[at] = beyond
            before[beyond] = at
            alive[gone] = False
            rank_at[gone] = NONE
            rank_at[at] = self.lookup(symbol[at], symbol[beyond])
            left = before[at]
            left = left[left >= 0]
            rank_at[left] = self.lookup(symbol[left], symbol[after[left]])
            touched = np.concatenate((at, left))
            lower = touched[rank_at[touched] < rank]
            if len(lower):  # such a piece is done again by the definition
                irregular.update(np.searchsorted(first, lower, side="right").tolist())
            note(touched)

        ids = symbol[alive].astype(ID)
        counts = np.add.reduceat(alive, first, dtype=np.int64)
        counts[sizes == 0] = 0
        stop = (np.cumsum(counts) * 4).tolist()
        data = ids.tobytes()
        out = [data[lo:hi] for lo, hi in zip([0, *stop], stop)]
        for word in irregular:
            out[word - 1] = np.array(self.encode_one(pieces[word - 1]), ID).tobytes()
        return out


class BlockEncoder:
    """Encodes blocks of texts; keeps a bounded cache of pieces between blocks."""

    def __init__(self, table: MergeTable, pattern: str, cache_pieces: int = CACHE_PIECES):
        self.table, self.split, self.limit = table, regex.compile(pattern).findall, cache_pieces
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, split = self.known, self.split
        parts, missing = [], set()
        for text in texts:
            pieces = split(text) if text else []
            parts.append(pieces)
            missing.update(p for p in set(pieces) if p not in known)
        fresh = sorted(missing)
        known.update(zip(fresh, self.table.replay([p.encode() for p in fresh])))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in parts]
        if len(known) > self.limit:
            self.known = {}
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.table.bytes_of.write(ids)[0]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BlockEncoder:
    """One encoder per Python worker and vocabulary."""
    return BlockEncoder(MergeTable.load(path), pattern)


#: Columns that encode() can add, in this order.
OUTPUTS = {
    "tokens": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}
#: Ends of a block of texts and of a stretch of the vocabulary that is replayed at once; neither changes a result.
BLOCK_CHARS, BLOCK_PIECES, REPLAY_CHARS, PIECES_AT_ONCE = 24_000_000, 300_000, 2_000_000, 1 << 22


class Numbers(dict):
    """Pieces by the order in which they were first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = found = len(self)
        return found

    def of(self, text: str | None, pattern: regex.Pattern) -> bytes:
        """The numbers of a text's pieces, all lowest bytes first: the higher ones are almost all zero and pack well."""
        if not text:
            return b""
        if len(text) > PIECES_AT_ONCE:  # no list of all pieces of a very long text
            codes = np.fromiter((self[m.group()] for m in pattern.finditer(text)), "<u4")
        else:
            pieces = pattern.findall(text)
            codes = np.fromiter(map(self.__getitem__, pieces), "<u4", len(pieces))
        return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()


def _codes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pieces(source: DataFrame, pattern: str, block_chars: int = BLOCK_CHARS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Step 1 over ``source``, whose last column is the text: columns ``c0``, ``c1``, ... are the others.

    A row of a text has them and ``codes``; a row of a block's list has ``piece`` and ``code``.  ``block`` joins the two: the
    task's partition and a count, the same for every attempt of the task that is committed.
    """
    kept = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(source.schema.fields[:-1])]
    schema = T.StructType([*kept, T.StructField("block", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("piece", T.StringType()), T.StructField("code", T.IntegerType())])

    def run(batches):
        split, partition, count, chars, numbers, kinds = regex.compile(pattern), TaskContext.get().partitionId(), 0, 0, Numbers(), None

        def listed():
            listed = list(numbers)
            for lo in range(0, len(listed), 1 << 16):
                part = listed[lo : lo + (1 << 16)]
                n, block = len(part), partition << 32 | count
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, k) for k in kinds], pa.array([block] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(part, pa.string()), pa.array(range(lo, lo + n), pa.int32())], schema.names)

        for batch in batches:
            kinds, lo, held = [c.type for c in batch.columns[:-1]], 0, []
            for hi, value in enumerate(batch.column(batch.num_columns - 1), 1):
                text = value.as_py()
                held.append(numbers.of(text, split))
                chars += len(text or "")
                full = chars >= block_chars or len(numbers) >= block_pieces
                if full or hi == batch.num_rows:
                    n, block = hi - lo, partition << 32 | count
                    own = [c.slice(lo, n) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([block] * n, pa.int64()), pa.array(held, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema.names)
                    held, lo = [], hi
                if full:
                    yield from listed()
                    chars, numbers, count = 0, Numbers(), count + 1
        if numbers:
            yield from listed()

    return storage.map_arrow(source, run, schema)


def replayed(words: DataFrame, path: str, replay_chars: int = REPLAY_CHARS) -> DataFrame:
    """Step 2 over ``words(block, code, piece)``: ``ids`` of every piece, as unsigned 16-bit integers."""

    def run(batches):
        table, held, chars, known = encoder(path, "").table, [], 0, {}

        def done():
            # the pieces come in order, so each is in one stretch, or the last of one and the first of the next
            all_pieces = dict.fromkeys(p for _, own in held for p in own)
            fresh = [p for p in all_pieces if p not in known]
            known.update(zip(fresh, table.replay([p.encode() for p in fresh])))
            for batch, own in held:
                ids = [np.frombuffer(known[p], ID).astype("<u2").tobytes() for p in own]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["block", "code", "ids"])
            last = next(reversed(all_pieces))
            kept = known[last]
            known.clear()
            known[last] = kept

        for batch in batches:
            own = batch.column(2).to_pylist()
            held.append((batch, own))
            chars += sum(map(len, own))
            if chars >= replay_chars:
                yield from done()
                held, chars = [], 0
        if held:
            yield from done()

    return words.select("block", "code", "piece").repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "block long, code int, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("tokens", "n_tokens"), text: str = "text", keep: tuple[str, ...] | None = None, block_chars: int = 6_000_000) -> DataFrame:
    """Columns of ``docs`` named in ``keep`` (all by default) with the token columns of ``outputs``.

    A column of ``docs`` with the name of an output gives way to it.  ``ids_sha256`` is taken over the decimal ids
    joined by commas, ``decoded_sha256`` over the bytes decoded from the ids.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in outputs)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"] + [T.StructField(o, OUTPUTS[o]) for o in outputs]
    storage.prepare(docs.sparkSession)

    def blocks(batches):
        held, chars = [], 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lo = 0
            for hi, t in enumerate(texts, 1):
                chars += len(t or "")
                if chars >= block_chars:
                    held.append((batch.slice(lo, hi - lo), texts[lo:hi]))
                    yield held
                    held, chars, lo = [], 0, hi
            if lo < len(texts):
                held.append((batch.slice(lo), texts[lo:]))
        if held:
            yield held

    def run(batches):
        enc = encoder(path, pattern)
        for held in blocks(batches):
            coded = enc.encode([t for _, texts in held for t in texts])
            at = 0
            for batch, texts in held:
                mine, at = coded[at : at + len(texts)], at + len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_columns(enc, mine, outputs)], [f.name for f in fields])

    return storage.map_arrow(source, run, T.StructType(fields))


def encode_by_corpus(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("tokens", "n_tokens"), text: str = "text", keep: tuple[str, ...] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``encode``, with every piece of the corpus replayed once."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in outputs)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]] + [T.StructField(o, OUTPUTS[o]) for o in outputs]
    storage.prepare(docs.sparkSession)
    cut = storage.materialize(pieces(source, pattern, block_chars), "pieces", compression="zstd")
    ids = replayed(cut.where("piece is not null"), path)
    columns = [f"c{k}" for k in range(len(keep))]
    texts = cut.where("codes is not null").select("block", "codes", *columns)

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        enc = encoder(path, "")
        by_code = words.take(pc.sort_indices(words.column("code")))
        listed = by_code.column("ids").to_pylist()
        flat, size = np.frombuffer(b"".join(listed), "<u2"), np.array([len(x) // 2 for x in listed], np.int64)
        start = np.cumsum(size) - size
        coded = []
        for packed in own.column("codes").to_pylist():
            codes = _codes(packed)
            n = size[codes]
            ends = np.cumsum(n)
            at = np.repeat(start[codes] - (ends - n), n)
            coded.append(flat[at + np.arange(len(at))].astype(ID).tobytes())
        return pa.Table.from_arrays([*[own.column(c).combine_chunks() for c in columns], *_columns(enc, coded, outputs)], [f.name for f in fields])

    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, T.StructType(fields))


def _columns(enc: BlockEncoder, coded: list[bytes], outputs: tuple[str, ...]) -> list[pa.Array]:
    made: dict[str, pa.Array] = {}
    if "tokens" in outputs:
        offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        made["tokens"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")), type=kind)
    if "n_tokens" in outputs:
        made["n_tokens"] = pa.array([len(c) // 4 for c in coded], pa.int64())
    if "ids_sha256" in outputs:
        made["ids_sha256"] = pa.array(enc.table.decimal_of.hashed(coded, trim=1), pa.string())
    if "decoded_sha256" in outputs:
        made["decoded_sha256"] = pa.array(enc.table.bytes_of.hashed(coded), pa.string())
    return [made[o] for o in outputs]


def decode(docs: DataFrame, path: str, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """Adds the binary column ``into``: the bytes of the ids in ``tokens`` (null ids: null bytes)."""
    storage.prepare(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name != into] + [T.StructField(into, T.BinaryType())])
    source = docs.select(*[F.col(f"`{f.name}`") for f in schema.fields[:-1]])

    def run(batches):
        piece_of = encoder(path, "").table.piece_of.__getitem__
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(tokens)).to_pylist()
            data = pa.array([None if i is None else b"".join(map(piece_of, i)) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], schema.names)

    return storage.map_arrow(source, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents``: ids and the decoded bytes, as digests."""
    import public_tokenizers

    docs = storage.table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(docs, str(path), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))
