"""Keyed snapshots that are updated in place of being rewritten.

A snapshot's rows lie in buckets by a hash of their key. An update reads and rewrites only the buckets that its changes touch, under a new version
number; a manifest of (bucket, version) is written last and makes the version visible, so readers see all of an update or nothing of it, and an
update that is run again under its number starts from the version before. Bytes written follow the changed buckets, not the snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Snapshot:
    """A keyed table under `path`, in `buckets` buckets. schema: of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        found = [int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()]
        return sorted(v for v in found if self._exists(f"{self.path}/manifest/{v}/_SUCCESS"))

    def _manifest(self, version: int | None) -> dict[int, int]:
        """The version of each bucket: no more rows than buckets."""
        if version is None:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{version}").collect()}

    def _rows(self, of: dict[int, int]) -> DataFrame:
        paths = [x for b, v in sorted(of.items()) if self._exists(x := f"{self.path}/data/{v}/bucket={b}")]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest committed version, or of one that is still kept."""
        known = self.versions()
        return self._rows(self._manifest(version if version is not None else known[-1] if known else None))

    def update(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
        """Rewrites the buckets that changes touch as combine(their rows, changes), and commits. Changes have the key columns; they are read
        twice. Without a number the next one is taken."""
        known = self.versions()
        version = version if version is not None else (known[-1] + 1 if known else 0)
        before = [v for v in known if v < version]
        old = self._manifest(before[-1] if before else None)
        changes = changes.withColumn("__bucket", self.bucket())
        touched = [r[0] for r in changes.select("__bucket").distinct().collect()]  # no more than buckets
        now = combine(self._rows({b: v for b, v in old.items() if b in touched}), changes.drop("__bucket")).select(*self.schema.names)
        now.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/{version}")
        new = old | {b: version for b in touched}
        self.spark.createDataFrame(sorted(new.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")
        self._drop(old, before, version)
        return version

    def _drop(self, old: dict[int, int], before: list[int], version: int) -> None:
        """Versions that neither the new manifest nor the one before it names."""
        for v in before[:-1]:
            for b, kept in self._manifest(v).items():
                if old.get(b) != kept:
                    fs, p = self._fs(f"{self.path}/data/{kept}/bucket={b}")
                    fs.delete(p, True)
            fs, p = self._fs(f"{self.path}/manifest/{v}")
            fs.delete(p, True)


def replaced(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with a key that changes have are replaced by these; a change whose other columns are all null only removes."""
    rest = [c for c in rows.columns if c != key]
    return rows.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(*rows.columns).dropna("all", subset=rest))
