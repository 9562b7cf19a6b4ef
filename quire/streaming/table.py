"""A table by key that takes small changes: buckets of immutable files under a manifest.

Rows lie in ``data/version=v/base=0|1/bucket=b``; the manifest of a version says which of these hold the rows of each
bucket, and how many.  ``merge`` writes only the rows it is given, as deltas of the buckets they fall in, so the bytes
written follow the change and not the table.  A bucket whose deltas have as many rows as its base, or are more
than ``MOST_DELTAS``, is written anew as a base in the same step: each row is rewritten a constant number of times.
A reader takes the last version of each key, and buckets without deltas are read as they are.

A merge done again with the same rows and number replaces itself (dynamic partition overwrite of the same partitions),
so a replayed batch gives the same table.  Manifests are renamed into place; readers of older ones find their files
until ``prune`` removes what no later manifest names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .. import storage

MOST_DELTAS = 16
PLACE = [StructField("version", LongType()), StructField("base", IntegerType()), StructField("bucket", IntegerType())]

#: bucket -> [(version, base, rows), ...], the base first.
Manifest = dict[int, list[tuple[int, int, int]]]


class KeyedTable:
    """A table of ``schema`` with one row per ``key``, in ``buckets`` buckets below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in storage.names(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That of the last version at or before the given one; empty where there is none."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        return {int(b): [tuple(x) for x in vs] for b, vs in json.loads(storage.get_text(self.spark, f"{self.path}/manifest/{known[-1]}.json")).items()}

    def _files(self, manifest: Manifest) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/base={base}/bucket={b}" for b, vs in manifest.items() for v, base, _ in vs]
        full = StructType([*self.schema.fields, *PLACE])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)

    def _last(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key, "bucket").agg(F.max_by(F.struct(*columns), "version").alias("_row")).select(self.key, "_row.*", "bucket")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last by default."""
        manifest = self.manifest(version)
        mixed = {b: vs for b, vs in manifest.items() if len(vs) > 1}
        rows = self._files({b: vs for b, vs in manifest.items() if len(vs) == 1}).select(*self.schema.names)
        return rows.unionByName(self._last(self._files(mixed)).select(*self.schema.names)) if mixed else rows

    def of(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the keys in ``keys``, read from the buckets they fall in only."""
        touched = [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most one row a bucket
        manifest = {b: vs for b, vs in self.manifest(version).items() if b in touched}
        return self._last(self._files(manifest)).drop("bucket").join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, base: int) -> dict[int, int]:
        """Writes rows as deltas or bases of a version; rows by bucket."""
        place = F.lit(version).cast("long").alias("version"), F.lit(base).alias("base")
        path = f"{self.path}/data"
        rows.select(*self.schema.names, *place, "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "base", "bucket").parquet(path)
        new = {int(n.partition("=")[2]): [(version, base, 0)] for n in storage.names(self.spark, f"{path}/version={version}/base={base}") if n.startswith("bucket=")}
        return {r.bucket: r.n for r in self._files(new).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a bucket

    def merge(self, changes: DataFrame, version: int) -> None:
        """The table with the rows of ``changes`` (one per key) in place of those of their keys, as ``version``."""
        manifest = self.manifest(version - 1)
        written = self._write(changes.withColumn("bucket", self._bucket()), version, 0)
        for b, n in written.items():
            manifest.setdefault(b, []).append((version, 0, n))
        full = {b: vs for b in written if len(vs := manifest[b]) > 1 and (len(vs) > MOST_DELTAS or sum(x[2] for x in vs[1:]) >= vs[0][2])}
        if full:
            for b, n in self._write(self._last(self._files(full)), version, 1).items():
                manifest[b] = [(version, 1, n)]
        storage.put_text(self.spark, f"{self.path}/manifest/{version}.json", json.dumps({str(b): vs for b, vs in sorted(manifest.items())}))

    def prune(self, versions: int = 2) -> None:
        """Removes manifests before the last ``versions``, and files of their time that none of the rest names."""
        known = self.versions()
        named = {(v, base, b) for k in known[-versions:] for b, vs in self.manifest(k).items() for v, base, _ in vs}
        for k in known[:-versions]:
            storage.remove(self.spark, f"{self.path}/manifest/{k}.json")
        number = lambda n: int(n.partition("=")[2])
        data = f"{self.path}/data"
        for v in (n for n in storage.names(self.spark, data) if n.startswith("version=") and known and number(n) < known[-1]):
            gone = {(base, b) for base in storage.names(self.spark, f"{data}/{v}") for b in storage.names(self.spark, f"{data}/{v}/{base}") if (number(v), number(base), number(b)) not in named}
            for base, b in gone:
                storage.remove(self.spark, f"{data}/{v}/{base}/{b}")
            if not any(x[0] == number(v) for x in named):
                storage.remove(self.spark, f"{data}/{v}")
