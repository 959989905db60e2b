"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlens.sources.sinks import new_folder

#: Word of most contracts: a run of anything but space and the controls 09 to 0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def residue(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % modulus


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes: small where values are small or repeat."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()
