from __future__ import annotations

import hashlib
import io
import math
import random
import wave
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caretide.llm import audio, storage


def test_wav_is_lossless_and_readable_elsewhere():
    rng = random.Random(1)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = audio.pad(bytes(rng.randrange(256) for _ in range(n)))
        media = audio.to_wav(payload)
        assert audio.from_wav(media) == (payload, audio.RATE) and len(payload) % 192 == 0 and len(payload) >= 192
        with wave.open(io.BytesIO(media)) as read:
            assert (read.getnchannels(), read.getsampwidth(), read.readframes(10**7)) == (1, 1, payload)
    assert audio.from_wav(audio.to_wav(b"abc"))[0] == b"abc"
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxWAVE")


def test_resampling_against_plain_convolution():
    """Zeros between samples, one low-pass filter, every third of the result."""
    samples = np.sin(np.arange(960) * 0.3) + 0.2 * np.cos(np.arange(960) * 0.05)
    samples[:32] = 0
    n = audio.TAPS * audio.UP
    t, cut = np.arange(n) - (n - 1) / 2, 1 / max(audio.UP, audio.DOWN)
    taps = audio.UP * cut * np.sinc(cut * t) * np.hamming(n)
    stuffed = np.zeros(len(samples) * audio.UP)
    stuffed[:: audio.UP] = samples
    expected = np.convolve(stuffed, taps)[: len(stuffed)][:: audio.DOWN]
    assert np.allclose(audio.resample(samples), expected)


def test_a_tone_rings_in_its_band():
    n = np.arange(19200)
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * n / audio.RATE)).astype(np.uint8).tobytes()
    peaks = [int(audio.log_mel(tone(f)).mean(axis=0).argmax()) for f in (200, 600, 1200, 2500)]
    assert peaks == sorted(set(peaks))


def test_spans_need_to_reach_the_upper_level():
    energy = np.array([0, 0, 0.4, 3, 0.4, 0, 0, 0.4, 0.4, 0, 0, 3, 3, 0.0])
    assert audio.spans(energy, enter=1.0, leave=-0.35) == [(2, 5), (11, 13)]
    assert audio.spans(np.zeros(5)) == [] and audio.spans(np.ones(1)) == []
    loud = bytes(128 for _ in range(1920)) + bytes(random.Random(1).randrange(256) for _ in range(1920)) + bytes(128 for _ in range(1920))
    found = audio.features(loud)[1]
    assert 0.12 < found[0][0] < 0.18 and 0.3 < found[-1][1] < 0.36


def test_query(spark, small, texts):
    same = {}
    rows = audio.query(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        media = audio.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert len(r.tensor) == 320 and all(0 <= s.begin_s < s.end_s <= len(payload) / audio.RATE + 1e-9 for s in r.spans)
        assert same.setdefault(texts[r.doc_id], r.feature) == r.feature


def test_tensors(spark, small):
    path = storage.new_path(spark, "features")
    audio.query(spark, small).select("doc_id", "tensor").coalesce(1).write.parquet(path)
    assert spark.read.parquet(path).schema["tensor"].metadata["shape"] == [16, 20]
    table = pq.read_table(path.removeprefix("file://"))
    tensors = audio.as_tensors(table["tensor"])
    assert tensors.type.shape == [16, 20] and tensors.to_numpy_ndarray().shape == (len(table), 16, 20)
    assert np.allclose(tensors.to_numpy_ndarray()[3].ravel(), table["tensor"][3].as_py())


def test_edge_rows(spark, edge, empty):
    path = storage.new_path(spark, "media")
    audio.store(edge.withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("clash")), path, metadata=("doc_id", "a.b", "media", "n_bytes"))
    rows = audio.analyse(spark.read.parquet(path)).collect()
    assert len(rows) == 9 and {(r.n_bytes, r.payload_bytes, len(r.spans)) for r in rows if r.doc_id in (2, 3)} == {(0, 192, 0)}
    path = storage.new_path(spark, "media")
    audio.store(empty, path)
    assert audio.analyse(spark.read.parquet(path)).count() == 0


def test_all_windows_are_stored_as_tensors_with_times(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(1, "".join(chr(rng.randrange(32, 500)) for _ in range(9000))), (2, "short"), (3, None)], "doc_id long, text string")
    media, features = storage.new_path(spark, "media"), storage.new_path(spark, "features")
    audio.store(docs, media)
    result = {r.doc_id: r for r in audio.analyse(spark.read.parquet(media), features).collect()}
    table = pq.read_table(features.removeprefix("file://"))
    for r in table.to_pylist():
        mel = audio.log_mel(audio.pad((docs.where(docs.doc_id == r["doc_id"]).first().text or "").encode()))
        got = np.array([b["mel"] for b in r["blocks"]], np.float32).reshape(-1, audio.MELS)
        assert len(got) == -(-len(mel) // 16) * 16 and np.abs(got[: len(mel)] - mel).max() <= audio.STEP and (got[len(mel) :] == audio.SILENCE).all()
        times = [(b["begin_s"], b["end_s"]) for b in r["blocks"]]
        assert all(a[1] == b[0] for a, b in zip(times, times[1:])) and times[0][0] == 0 and abs(times[-1][1] - len(mel) * 0.016) < 1e-9
        assert result[r["doc_id"]].feature.startswith(f"{len(r['blocks'])}x16x20:{zlib.crc32(got.tobytes()):08x}:")
    assert "blocks" not in result[1].asDict()


def plain_log_mel(payload):
    """Sample by sample: zeros between samples and one filter, a transform of each window by its definition, triangles."""
    samples = (np.frombuffer(payload, np.uint8) - 128.0) / 128
    samples = samples - samples.mean()
    n = audio.TAPS * audio.UP
    t = np.arange(n) - (n - 1) / 2
    taps = audio.UP / 3 * np.sinc(t / 3) * np.hamming(n)
    held = np.concatenate((np.full(audio.TAPS, samples[0]), samples))
    stuffed = np.zeros(len(held) * audio.UP)
    stuffed[:: audio.UP] = held
    out = np.convolve(stuffed, taps)[audio.TAPS * audio.UP :][: len(samples) * audio.UP][:: audio.DOWN]
    out = np.concatenate((out, np.full(128, out[-1])))
    k = np.arange(129)
    turn = np.exp(-2j * np.pi * k[:, None] * np.arange(256) / 256)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(4000) * j / 21 / 2595) - 1) for j in range(22)]
    rows = []
    for at in range(0, len(out) - 128, 128):
        power = np.abs(turn @ (out[at : at + 256] * hann)) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            f = k * 4000 / 128
            row.append(math.log10(1e-6 + float(power @ np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None))))
        rows.append(row)
    return np.array(rows)


def test_query_against_plain_features(spark, small, texts):
    """Tensor, spans and digest of documents, from features worked out by their definitions."""
    rows = {r.doc_id: r for r in audio.query(spark, small).collect()}
    for i in sorted(texts)[:12]:
        mel = plain_log_mel(audio.pad((texts[i] or "").encode()))
        n = len(mel)
        cuts = [n * k / 16 for k in range(17)]
        expected = [mel[min(math.floor(a), n - 1) : max(math.ceil(b), min(math.floor(a), n - 1) + 1)].mean(axis=0) for a, b in zip(cuts, cuts[1:])]
        assert np.allclose(np.array(rows[i].tensor).reshape(16, 20), expected, atol=audio.STEP)
        level = mel.mean(axis=1)
        level = (level - level.mean()) / max(level.std(), 1e-12)
        spans, k = [], 0
        while k < n:
            end = k
            while end < n and level[end] >= -0.25:
                end += 1
            if end > k and max(level[k:end]) >= 0.5:
                spans.append((k * 0.016, end * 0.016))
            k = end + 1
        assert np.allclose([(s.begin_s, s.end_s) for s in rows[i].spans], spans)
        assert rows[i].feature.split(":")[::2] == [f"{-(-n // 16)}x16x20", str(len(spans))]


def test_metadata_named_like_a_result_gives_way(spark, edge):
    path = storage.new_path(spark, "media")
    audio.store(edge.withColumn("payload_bytes", F.lit("clash")).withColumn("tensor", F.lit(0)), path, metadata=("doc_id", "payload_bytes", "tensor", "lang"))
    out = audio.analyse(spark.read.parquet(path))
    assert out.columns == ["doc_id", "lang", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "spans"]
    assert out.where("payload_bytes >= 192").count() == 9 and len(out.first().tensor) == 320
