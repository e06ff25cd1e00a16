"""Pixel-interleaved files of fixed-length integer records, as a Spark data source named `bip`.

A record is the values of one pixel, line by line and sample by sample; a partition is a run of lines, read by one seek. Files are read
with pyarrow's file systems, so they may lie in any store that those reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH = 4_000_000  # values in an Arrow batch, about


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


@dataclass
class Lines(InputPartition):
    file: str
    first: int
    count: int


class BipReader(DataSourceReader):
    def __init__(self, path: str, nbands: int, dtype: str, samples: int, chunk: int) -> None:
        self.path, self.nbands, self.dtype, self.samples, self.chunk = path, nbands, np.dtype(dtype), samples, chunk
        self.line = samples * nbands * self.dtype.itemsize

    def partitions(self) -> list[Lines]:
        store, at = opened(self.path)
        found = store.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not re.search(r"\.(hdr|crc)$|/[._][^/]*$", f.path)]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            lines, rest = divmod(f.size, self.line)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole lines of {self.line}")
            out += [Lines(f.path, i, min(self.chunk, lines - i)) for i in range(0, lines, self.chunk)]
        return out or [Lines("", 0, 0)]

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = opened(self.path)
        step = max(1, BATCH // (self.samples * self.nbands))
        with store.open_input_file(part.file) as f:
            f.seek(part.first * self.line)
            for i in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - i)
                x = np.frombuffer(f.read(n * self.line), self.dtype).astype(np.int32)
                rows = n * self.samples
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, self.nbands, dtype=np.int32)), pa.array(x))
                at = np.arange(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.file] * rows, pa.string()), pa.array((i + at // self.samples).astype(np.int32)), pa.array((at % self.samples).astype(np.int32)), values],
                    names=["file", "line", "sample", "values"])


class BipSource(DataSource):
    """Options: path (a file or folder), nbands, dtype (numpy, with its byte order), samples, lines (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "bip"

    def schema(self) -> str:
        return "file string, line int, sample int, values array<int>"

    def reader(self, schema: StructType) -> BipReader:
        o = self.options
        return BipReader(o["path"], int(o.get("nbands", 365)), o.get("dtype", "<i2"), int(o.get("samples", 2400)), int(o.get("lines", 16)))


def read_bip(spark: SparkSession, path: str, nbands: int = 365, dtype: str = "<i2", samples: int = 2400, lines: int = 16) -> DataFrame:
    """(file, line, sample, values): the record of each pixel, lines and samples from 0."""
    spark.dataSource.register(BipSource)
    return spark.read.format("bip").option("path", path).option("nbands", nbands).option("dtype", dtype).option("samples", samples).option("lines", lines).load()


def bip_series(records: DataFrame, first: str, scale: float = 1e-4, fill: int = 32767, samples: int = 2400) -> DataFrame:
    """(pixel_id, obs_date, value): one row for each value, a day for each band from `first` on; the fill becomes NULL. Cells count from 1."""
    d = records.select((F.col("line").cast("long") * samples + F.col("sample") + 1).alias("pixel_id"), F.posexplode("values").alias("band", "value"))
    return d.select("pixel_id", F.date_add(F.lit(first).cast("date"), F.col("band")).alias("obs_date"), F.when(F.col("value") != fill, F.col("value") * scale).alias("value"))
