"""Media columns: lossless 8-bit audio, and log-mel features of what is read back.

A payload (the UTF-8 bytes of a text, padded with spaces to a positive multiple of 192) is stored as the samples of an
8-bit mono WAV file.  Features come from the stored bytes: the samples are resampled 2:3 by a polyphase filter, cut into
overlapped windows and turned into log-mel energies; hysteresis on the energy of the windows gives time spans of activity.
A unit of 192 samples is one hop after resampling, so no part of a payload is left over.  All log-mel rows are stored, 16
windows to a tensor of fixed shape with its begin and end in seconds, beside an overview tensor of the same shape that
averages them over the text.  The stored tensors are read back in Arrow's fixed-shape type for the digest.

Defined cases: a null or empty text is a payload of 192 spaces; constant samples have no spans; equal texts give equal
values, as every text is processed alone, so repeated rows and rows of equal or null ids each have their own; very long
texts are stored whole and their spectra taken some windows at a time, the last tensor filled up with silence; an
empty table gives no rows; columns of ``metadata`` keep any name but those of the format, which give way.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

UNIT = 192
RATE = 12_000  #: samples a second of the stored form; a unit lasts 16 ms
UP, DOWN, TAPS = 2, 3, 16  #: resampling, and filter taps of each phase
WINDOW, HOP = 256, 128  #: samples after resampling
MELS, BINS = 20, 16  #: the tensor's shape is (BINS, MELS)
SHAPE = (BINS, MELS)
STEP = 1 / 256  #: of the stored log energies
SILENCE = -6.0  #: log energy of a window without any


def pad(data: bytes) -> bytes:
    units = max(1, -(-len(data) // UNIT))
    return data.ljust(units * UNIT, b" ")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono PCM; a chunk of odd length gets a byte of padding, as the format asks."""
    body = payload + b"\0" * (len(payload) % 2)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(body), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=1)
def _phases() -> list[tuple[int, np.ndarray]]:
    """For each output phase: the input offset of its newest sample, and its taps, newest last."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    low_pass = UP * cut * np.sinc(cut * t) * np.hamming(n)
    out = []
    for k in range(UP):
        at = k * DOWN
        out.append((at // UP, np.ascontiguousarray(low_pass[at % UP :: UP][::-1])))
    return out


def resample(samples: np.ndarray) -> np.ndarray:
    """UP/DOWN times as many samples; of each phase only the outputs that are kept are computed.

    Before the first sample its value is taken to hold, so that a level other than 0 does not begin with a click.
    """
    windows = sliding_window_view(np.concatenate((np.full(TAPS - 1, samples[0]), samples)), TAPS)
    out = np.empty(len(samples) // DOWN * UP)
    for k, (first, taps) in enumerate(_phases()):
        out[k::UP] = windows[first::DOWN][: len(samples) // DOWN] @ taps
    return out


@lru_cache(maxsize=1)
def _mel_bank(rate: float) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, one column each, over the bins of a window's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, WINDOW // 2 + 1)[:, None]
    rise, fall = (f - points[:-2]) / (points[1:-1] - points[:-2]), (points[2:] - f) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_HANN = np.hanning(WINDOW + 1)[:-1]


def log_mel(payload: bytes, rate: int = RATE) -> np.ndarray:
    """One row of MELS log energies for each unit of the payload, half overlapped."""
    samples = (np.frombuffer(payload, np.uint8) - 128.0) / 128
    samples = resample(samples - samples.mean())
    windows = sliding_window_view(np.concatenate((samples, np.full(WINDOW - HOP, samples[-1]))), WINDOW)[::HOP]
    out = np.empty((len(windows), MELS))
    bank = _mel_bank(rate * UP / DOWN)
    for lo in range(0, len(windows), 1024):
        spectrum = np.fft.rfft(windows[lo : lo + 1024] * _HANN)
        out[lo : lo + 1024] = np.log10(10**SILENCE + (spectrum.real**2 + spectrum.imag**2) @ bank)
    return out


def blocks(mel: np.ndarray) -> np.ndarray:
    """The rows in steps of ``STEP``, as tensors of ``SHAPE`` one after the other."""
    rows = np.full((-(-len(mel) // BINS) * BINS, MELS), SILENCE, np.float32)
    rows[: len(mel)] = np.round(mel / STEP) * STEP
    return rows.reshape(-1, *SHAPE)


def spans(energy: np.ndarray, enter: float = 0.5, leave: float = -0.25) -> list[tuple[int, int]]:
    """Runs of windows that stay above mean + leave * deviation and reach mean + enter * deviation."""
    deviation = float(energy.std())
    if deviation < 1e-9:
        return []
    level = (energy - energy.mean()) / deviation
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (level >= leave).astype(np.int8), [0]))))
    reach = np.concatenate(([0], np.cumsum(level >= enter)))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if reach[b] > reach[a]]


def second(rate: int = RATE) -> float:
    """A window stands for its hop."""
    return HOP * DOWN / UP / rate


def overview(mel: np.ndarray) -> np.ndarray:
    """The rows averaged into one tensor of ``SHAPE``."""
    cuts = np.linspace(0, len(mel), BINS + 1)
    lo = np.minimum(np.floor(cuts[:-1]).astype(int), len(mel) - 1)
    hi = np.maximum(np.ceil(cuts[1:]).astype(int), lo + 1)
    sums = np.concatenate((np.zeros((1, MELS)), np.cumsum(mel, axis=0)))
    return ((sums[hi] - sums[lo]) / (hi - lo)[:, None]).astype(np.float32)


def timed(mel: np.ndarray, rate: int = RATE) -> list[tuple[float, float]]:
    """The spans in seconds."""
    return [(a * second(rate), b * second(rate)) for a, b in spans(mel.mean(axis=1))]


def features(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]]]:
    mel = log_mel(payload, rate)
    return overview(mel), timed(mel, rate)


def store(docs: DataFrame, path: str, text: str = "text", metadata: tuple[str, ...] = ("doc_id",)) -> None:
    """Write the columns of ``metadata`` (but for those named like a column of the format), n_bytes and media."""
    storage.prepare(docs.sparkSession)
    kept = [docs.schema[c] for c in metadata if c not in ("n_bytes", "media")]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(pad(d)) for d in data], pa.binary())], schema.names)

    storage.map_arrow(source, run, schema).write.options(compression="zstd").parquet(path)


SPANS = T.ArrayType(T.StructType([T.StructField("begin_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("begin_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("mel", T.ArrayType(T.FloatType()))]))
DIGESTS = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())]
TENSOR = {"shape": list(SHAPE), "axes": ["time", "mel"]}


def _lists(tensors: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tensors) + 1, dtype=np.int32) * math.prod(SHAPE)), pa.array(np.asarray(tensors, np.float32).ravel()))


def featurize(stored: DataFrame) -> DataFrame:
    """Adds digests of the stored bytes and of the samples, ``spans``, and ``blocks``: every 16 windows as a flat tensor
    ``mel`` of ``SHAPE``, with its begin and end."""
    storage.prepare(stored.sparkSession)
    own = {"media", "feature", "tensor", "spans", "blocks", *(n for n, _ in DIGESTS)}
    kept = [f for f in stored.schema.fields if f.name not in own]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in DIGESTS], T.StructField("spans", SPANS), T.StructField("blocks", BLOCKS)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    spans_type = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("media")
            rows, times, cut, begins, ends = [], [], [], [], []
            for value in batch.column(at):
                media = value.as_py()
                payload, rate = from_wav(media)
                mel = log_mel(payload, rate)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()))
                times.append([{"begin_s": a, "end_s": b} for a, b in timed(mel, rate)])
                cut.append(blocks(mel))
                first = np.arange(len(cut[-1])) * BINS
                begins.append(first * second(rate))
                ends.append(np.minimum(first + BINS, len(mel)) * second(rate))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]
            items = [np.concatenate(x) if x else np.zeros(0) for x in (begins, ends, cut)]
            structs = pa.StructArray.from_arrays([pa.array(items[0]), pa.array(items[1]), _lists(items[2])], ["begin_s", "end_s", "mel"])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in begins]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n not in own], *columns, pa.array(times, spans_type), pa.ListArray.from_arrays(pa.array(offsets), structs)], schema.names)

    return storage.map_arrow(stored, run, schema)


def analyse(stored: DataFrame, path: str | None = None) -> DataFrame:
    """Features of stored media, written to ``path`` (by default in the shared folder) and read back: all columns of
    ``featurize`` but the blocks, with ``feature``, a digest of the blocks and spans as they were stored, and ``tensor``, the
    overview of the stored rows."""
    spark = stored.sparkSession
    path = path or storage.new_path(spark, "features")
    made = featurize(stored)
    made.write.options(compression="zstd").parquet(path)
    kept = [f for f in made.schema.fields if f.name not in ("spans", "blocks")]
    schema = T.StructType([*kept, T.StructField("feature", T.StringType()), T.StructField("tensor", T.ArrayType(T.FloatType())), T.StructField("spans", SPANS)])

    def run(batches):
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            tensors = as_tensors(pc.struct_field(column["blocks"].flatten(), "mel")).to_numpy_ndarray() if batch.num_rows else []
            out, views, at = [], [], 0
            for n, payload, found in zip(pc.list_value_length(column["blocks"]).to_pylist(), column["payload_bytes"].to_pylist(), column["spans"].to_pylist()):
                out.append(f"{n}x{BINS}x{MELS}:{zlib.crc32(tensors[at : at + n].tobytes()):08x}:{len(found)}:{sum(s['end_s'] - s['begin_s'] for s in found):.3f}")
                views.append(overview(tensors[at : at + n].reshape(-1, MELS)[: payload // UNIT].astype(np.float64)))
                at += n
            column["feature"], column["tensor"] = pa.array(out, pa.string()), _lists(np.array(views))
            yield pa.RecordBatch.from_arrays([column[n] for n in schema.names], schema.names)

    found = storage.map_arrow(spark.read.schema(made.schema).parquet(path), run, schema)
    # the shape goes with the column into Parquet and back
    return found.select(*[F.col("tensor").alias("tensor", metadata=TENSOR) if c == "tensor" else F.col(f"`{c}`") for c in found.columns])


def as_tensors(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column of flat tensors, as read from Parquet, in Arrow's fixed-shape tensor type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = math.prod(SHAPE)
    values = column.values.slice(column.offsets[0].as_py() if len(column) else 0, len(column) * size)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), SHAPE), pa.FixedSizeListArray.from_arrays(values, size))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as audio, stored, read back and analysed."""
    path = storage.new_path(spark, "media")
    store(storage.table(spark, sf_dir, "documents"), path)
    return analyse(spark.read.parquet(path))
