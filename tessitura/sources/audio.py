"""Uncompressed audio as sample rows; other formats need a decoder and come in as tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessitura.operators.frames import frame_evidence


def decode_wave(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1, and the rate, of a PCM file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    kinds = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    if width not in kinds:
        raise ValueError("8, 16 or 32 bits are needed")
    kind, middle, scale = kinds[width]
    samples = (np.frombuffer(raw, kind).astype(np.float32) - middle) / scale
    return samples.reshape(-1, channels).mean(1), rate


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, rate): mono samples of each wave file; a task decodes one file at a time."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, rate = decode_wave(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([samples], pa.list_(pa.float32())), pa.array([rate], pa.int32())], names=["path", "samples", "rate"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, samples array<float>, rate int")


def wave_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame evidence of each wave file (path, i, t, rms, per, flux, timbre)."""
    return frame_evidence(read_waves(spark, path), "path")
