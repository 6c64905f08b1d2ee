"""Recordings (mono 16-bit WAV files) as a data source: rows are stretches of a file, and files of any length are read
by several tasks.

    spark.read.format("recordings").option("path", folder).load().filter("start_ms >= 5000 and start_ms < 6000")

A row is a stretch of ``stretchMs``: name (of the file, without ``.wav``), start_ms, end_ms and samples. The driver lists
names and sizes alone and plans byte ranges of ``partitionBytes`` at most; conditions on name and start_ms shorten the
plan, and a task seeks to its range. Writing takes rows of ``write_recordings``, which brings the stretches of a name
together in order; a task writes whole files beside their place, and the commit of the job puts them in place.

Null samples count as empty; a file that is no mono 16-bit WAV file of the rate ends the job; a file without samples has
no rows; a folder without files gives no rows.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from zeitband.functions.audio import HEADER, RATE, to_pcm

SCHEMA = "name string, start_ms long, end_ms long, samples array<float>"
TO_WRITE = "name string, start_ms long, samples array<float>, total long"


def read_at(file: pa.NativeFile, start: int, n: int) -> bytes:
    return file.read_at(n, start)


def header(n_bytes: int, rate: int) -> bytes:
    return b"RIFF" + struct.pack("<I", (36 + n_bytes) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", n_bytes & 0xFFFFFFFF)


@dataclass
class Stretches(InputPartition):
    """The stretches ``first`` to ``last`` - 1 of a file, whose data ends at byte ``end``."""

    path: str
    first: int
    last: int
    end: int


class Bounds:
    """What conditions leave of names and starts."""

    def __init__(self):
        self.names: set[str] | None = None
        self.least, self.below = -math.inf, math.inf

    def take(self, f: Filter) -> bool:
        """Narrow the bounds by a condition, if it is of a kind that they express."""
        at, value = f.attribute, getattr(f, "value", None)
        if at == ("name",) and isinstance(f, (EqualTo, In)):
            own = {value} if isinstance(f, EqualTo) else set(value)
            self.names = own if self.names is None else self.names & own
        elif at == ("start_ms",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.below = min(self.below, value + (not isinstance(f, LessThan)))
        else:
            return False
        return True


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, rate: int, stretch_ms: int, partition_bytes: int):
        self.path, self.rate, self.stretch_ms = path, rate, stretch_ms
        self.bytes = rate * stretch_ms // 1000 * 2
        self.each = max(1, partition_bytes // self.bytes)
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.take(f)]

    def partitions(self) -> list[Stretches]:
        where, folder = fs.FileSystem.from_uri(self.path)
        made = []
        for info in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            name = info.base_name.removesuffix(".wav")
            if name == info.base_name or self.bounds.names is not None and name not in self.bounds.names:
                continue
            whole = max(0, -(-(info.size - HEADER) // self.bytes))
            first = max(0, math.ceil(self.bounds.least / self.stretch_ms)) if self.bounds.least > -math.inf else 0
            last = min(whole, math.ceil(self.bounds.below / self.stretch_ms)) if self.bounds.below < math.inf else whole
            made += [Stretches(info.path, s, min(last, s + self.each), info.size) for s in range(first, last, self.each)]
        return made or [Stretches("", 0, 0, 0)]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        name = partition.path.rpartition("/")[2].removesuffix(".wav")
        with where.open_input_file(partition.path) as file:
            head = read_at(file, 0, HEADER)
            if head[:4] != b"RIFF" or struct.unpack_from("<HI6xH", head, 22) != (1, self.rate, 16):
                raise ValueError(f"{name} is no mono 16-bit WAV file of the rate asked for")
            for k in range(partition.first, partition.last):
                raw = read_at(file, HEADER + k * self.bytes, min(self.bytes, partition.end - HEADER - k * self.bytes))
                x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / np.float32(32768)
                start = k * self.stretch_ms
                columns = [pa.array([name]), pa.array([start]), pa.array([start + len(x) * 1000 // self.rate]), pa.array([x], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "start_ms", "end_ms", "samples"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RecordingWriter(DataSourceWriter):
    """Files are written to a folder of the job's own, under names that a task that runs again writes over."""

    def __init__(self, path: str, rate: int):
        self.path, self.rate, self.job = path, rate, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        where, folder = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{folder}/{self.job}", recursive=True)
        names, out = [], None
        try:
            for name, _, samples, total in iterator:
                if not names or name != names[-1]:
                    if out:
                        out.close()
                    names.append(name)
                    out = where.open_output_stream(f"{folder}/{self.job}/{name}.wav", compression=None)
                    out.write(header(total * 2, self.rate))
                out.write(to_pcm(np.asarray(samples or [], np.float32)))
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = fs.FileSystem.from_uri(self.path)
        for m in filter(None, messages):
            for name in m.names:
                where.move(f"{folder}/{self.job}/{name}.wav", f"{folder}/{name}.wav")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = fs.FileSystem.from_uri(self.path)
        if where.get_file_info(f"{folder}/{self.job}").type != fs.FileType.NotFound:
            where.delete_dir(f"{folder}/{self.job}")


class Recordings(DataSource):
    """Options: path (a URI of a folder), rate, stretchMs, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def _rate(self) -> int:
        return int(self.options.get("rate", RATE))

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(self.options["path"], self._rate(), int(self.options.get("stretchMs", 1000)), int(self.options.get("partitionBytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"], self._rate())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see conditions."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def recordings(spark: SparkSession, path: str, rate: int = RATE, stretch_ms: int = 1000) -> DataFrame:
    register(spark)
    return spark.read.format("recordings").option("path", path).option("rate", rate).option("stretchMs", stretch_ms).load()


def write_recordings(rows: DataFrame, path: str, rate: int = RATE) -> None:
    """Write a file for each name of ``rows`` (name, start_ms, samples), its stretches one after the other. All files are
    in place after the job, or none is new."""
    register(rows.sparkSession)
    n = F.coalesce(F.greatest(F.size("samples"), F.lit(0)), F.lit(0))
    own = rows.filter("name is not null").select(F.col("name").cast("string").alias("name"), F.col("start_ms").cast("long").alias("start_ms"), "samples")
    whole = own.withColumn("total", F.sum(n).over(Window.partitionBy("name")).cast("long"))
    dealt = whole.repartition("name").sortWithinPartitions("name", "start_ms")
    dealt.write.format("recordings").option("path", path).option("rate", rate).mode("append").save()
