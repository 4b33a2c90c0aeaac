"""Audio files as rows: path, sample rate and mono samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators.signal import resampled

SCHEMA = "path string, sha256 string, sample_rate int, samples array<float>, status string"


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mean of the channels, -1 to 1, of PCM with 8 to 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return rate, x.reshape(-1, channels).mean(axis=1)


def read_audio(spark: SparkSession, folder: str, pattern: str = "*.wav", to_rate: int | None = None) -> DataFrame:
    """One row a file, at ``to_rate`` if it is given; a file that can't be decoded is a row with a status, not a failed task."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rate, x = decode_wav(content)
                    if to_rate:
                        rate, x = to_rate, resampled(x, rate, to_rate)
                    row = (path, digest, rate, x.tolist(), "ok")
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    row = (path, digest, None, None, f"error: {e}"[:200])
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "sha256", "sample_rate", "samples", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(decode, SCHEMA)


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, bytes, changed and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("sha256"))
