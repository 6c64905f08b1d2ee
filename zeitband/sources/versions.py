"""Tables that share a key and change together: buckets of files by key, and one manifest that names both tables' files.

An edit rewrites the buckets that its keys fall in, under new names, and then puts the next manifest in place by a rename
that never overwrites. So all tables change at once or not at all: readers of the manifest before see the version before,
a job that is killed midway leaves nothing but files that no manifest names, and of two writers that began with one
version one gets a ``Conflict``. Within a bucket rows are sorted by key; Parquet files have Bloom filters on it, so a
lookup opens one bucket and skips what is left of it by statistics. A bucket is written by one task, in memory as far as
it is sorted, and read by one: ``buckets_for`` says how many to have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zeitband.shared import small_tasks

Tables = Mapping[str, DataFrame]


#: Rows in a bucket.
BUCKET_ROWS = 200_000


def buckets_for(rows: int) -> int:
    """The number of buckets for so many rows."""
    return max(16, -(-rows // BUCKET_ROWS))


class Conflict(Exception):
    """Another writer has made the next version."""


class VersionedTables:
    """Tables under ``path``. ``schemas`` and ``key`` say what they hold; a null key is in bucket 0."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, StructType | str], key: str, buckets: int = 16, kind: str = "parquet"):
        self.spark, self.path, self.key, self.buckets, self.kind = spark, path.rstrip("/"), key, buckets, kind
        self.schemas = {n: StructType.fromDDL(s) if isinstance(s, str) else s for n, s in schemas.items()}
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _bucket(self) -> Column:
        return F.when(F.col(self.key).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets))).cast("int")

    # Manifests.

    def version(self) -> int:
        """The newest version, 0 before the first edit."""
        names = [f.getPath().getName() for f in self._files.globStatus(self._at(f"{self.path}/version-*.json")) or ()]
        return max((int(n[8:-5]) for n in names), default=0)

    def manifest(self, version: int) -> dict[str, dict[str, list[str]]]:
        """The files of each bucket (its number as text) of each table."""
        return self._manifest(version)["tables"]

    def note(self) -> dict:
        """What the edit that made the newest version said with it."""
        return self._manifest(self.version())["note"]

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"tables": {n: {} for n in self.schemas}, "note": {}}
        return json.loads(self.spark.read.text(f"{self.path}/version-{version:010d}.json", wholetext=True).first()[0])

    def _publish(self, version: int, tables: dict, note: dict) -> None:
        made, target = self._at(f"{self.path}/.{uuid.uuid4().hex}"), self._at(f"{self.path}/version-{version:010d}.json")
        out = self._files.create(made, False)
        out.write(json.dumps({"tables": tables, "note": note}).encode())
        out.close()
        conf = self.spark._jsc.hadoopConfiguration()
        never = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        never[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            self._hadoop.FileContext.getFileContext(self._files.getUri(), conf).rename(self._files.makeQualified(made), self._files.makeQualified(target), never)
        except Py4JJavaError as e:
            self._files.delete(made, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there already") from e
            raise

    # Reads.

    def _read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        files = [f for b, fs in manifest[table].items() if buckets is None or int(b) in buckets for f in fs]
        if not files:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.format(self.kind).schema(self.schemas[table]).load([f"{self.path}/{f}" for f in files])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was in an earlier version."""
        return self._read(self.manifest(self.version() if version is None else version), table)

    def find(self, table: str, key: object) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        one = self.spark.range(1).select(F.lit(key).cast(self.schemas[table][self.key].dataType).alias(self.key)).select(self._bucket())
        return self._read(self.manifest(self.version()), table, [one.first()[0]]).filter(F.col(self.key) == F.lit(key))

    def read_buckets(self, table: str, buckets: list[int], version: int) -> DataFrame:
        """The rows of some buckets, by number, as they were in a version."""
        return self._read(self.manifest(version), table, buckets)

    # Edits.

    def dealt(self, rows: DataFrame, count: int) -> DataFrame:
        """``rows`` with their bucket (``__bucket``), of which there are ``count``, each in one partition."""
        return rows.withColumn("__bucket", self._bucket()).repartition(max(1, count), "__bucket")

    def without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows of ``rows`` whose key isn't in ``keys``, dealt by bucket. Null keys are in none."""
        gone = keys.select(self.key).filter(F.col(self.key).isNotNull()).withColumn("__key", F.lit(True))
        dealt = self.dealt(rows.withColumn("__key", F.lit(False)).unionByName(gone, allowMissingColumns=True), len(self.buckets_of(keys)))
        return dealt.withColumn("__any", F.max("__key").over(Window.partitionBy("__bucket", self.key))).filter("not __any").select(*rows.columns)

    def _write(self, table: str, rows: DataFrame, touched: list[int], in_place: bool = False) -> dict[str, list[str]]:
        place = f"data/{uuid.uuid4().hex}"
        own = rows.select(*self.schemas[table].fieldNames()).withColumn("__bucket", self._bucket()).filter(F.col("__bucket").isin(touched))
        dealt = own if in_place else own.repartition(len(touched), "__bucket")
        out = dealt.sortWithinPartitions("__bucket", self.key).write.partitionBy("__bucket")
        if self.kind == "parquet":
            # A column with a dictionary gets no Bloom filter.
            out = out.option(f"parquet.enable.dictionary#{self.key}", "false").option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("compression", "zstd")
        elif self.kind == "json":
            out = out.option("ignoreNullFields", "false").option("compression", "gzip")
        with small_tasks(rows.sparkSession):
            out.format(self.kind).save(f"{self.path}/{place}")
        made: dict[str, list[str]] = {}
        for f in self._files.globStatus(self._at(f"{self.path}/{place}/__bucket=*/part-*")) or ():
            folder, name = f.getPath().getParent().getName(), f.getPath().getName()
            made.setdefault(folder.removeprefix("__bucket="), []).append(f"{place}/{folder}/{name}")
        return made

    def edit(self, keys: DataFrame, change: Callable[[Tables], Mapping[str, DataFrame | tuple]], base: int | None = None, note: dict | None = None) -> int:
        """Put what ``change`` makes of the tables in place of them, and return the new version.

        ``keys`` holds the key of every row that may change. ``change`` gets the tables' rows of the buckets of these
        keys, and gives all rows that shall be in those buckets then, of each table that it changes; or such rows and
        fewer keys, whose buckets alone are written; or, third, that the rows lie by bucket already. ``base`` is the version that the change was made for; by default the
        newest. ``note`` is kept with the version, and makes one even if there are no keys.
        """
        base = self.version() if base is None else base
        old = self.manifest(base)
        touched = self.buckets_of(keys)
        if not touched and note is None:
            return base
        new = dict(old)
        for table, made in change({t: self._read(old, t, touched) for t in self.schemas}).items() if touched else ():
            rows, own = (made[0], self.buckets_of(made[1])) if isinstance(made, tuple) else (made, touched)
            in_place = isinstance(made, tuple) and len(made) > 2 and made[2]
            kept = {b: fs for b, fs in old[table].items() if int(b) not in own}
            new[table] = kept | (self._write(table, rows, own, in_place) if own else {})
        self._publish(base + 1, new, note or {})
        return base + 1

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``: numbers below ``buckets``."""
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def clean(self, keep: int = 1) -> None:
        """Delete the manifests before the newest ``keep``, and all files that no manifest names. Not while others write."""
        newest = self.version()
        named = {f for v in range(max(1, newest - keep + 1), newest + 1) for fs in self.manifest(v).values() for x in fs.values() for f in x}
        for v in range(1, newest - keep + 1):
            self._files.delete(self._at(f"{self.path}/version-{v:010d}.json"), False)
        for f in self._files.globStatus(self._at(f"{self.path}/data/*/__bucket=*/part-*")) or ():
            name = f"data/{f.getPath().getParent().getParent().getName()}/{f.getPath().getParent().getName()}/{f.getPath().getName()}"
            if name not in named:
                self._files.delete(f.getPath(), False)
