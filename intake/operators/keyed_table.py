"""A keyed table on plain Parquet: rows in buckets by a hash of their key, and a manifest for each version that names the live files.

A write reads and rewrites only the buckets that its batch touches. New files go to a folder of their own, and the manifest that names them
comes last, under a number that can be taken once: a task or driver that dies before leaves the old version as it was, and a second
writer that started from the same version is refused. Readers keep to the version that they opened.

NULLs in keys are equal. The manifest holds a list of files for each bucket, so its size follows `buckets`, not the rows; choose `buckets`
so that one of them is rewritten by one task. It must be the same at every write, and so it stands in the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import first_of_key, insert_if_absent, upsert

BUCKETS = 64
_BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer made this version first; nothing of this write is visible."""


@dataclass
class Manifest:
    version: int
    buckets: int
    keys: list[str]
    schema: dict
    files: dict[int, list[str]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "keys": self.keys, "schema": self.schema, "files": {str(b): f for b, f in sorted(self.files.items())}})

    @classmethod
    def of(cls, text: str) -> Manifest:
        held = json.loads(text)
        return cls(held["version"], held["buckets"], held["keys"], held["schema"], {int(b): f for b, f in held["files"].items()})


class _Files:
    """The few calls to Hadoop's file system that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Writes the whole file under this name, or nothing if it is there. The rename is what takes the name."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self.path(name), options)
        except Exception as e:  # py4j wraps whatever the file system throws
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(draft, False)
            return False
        return True


class KeyedTable:
    """The table under `path`; `open` finds it or makes an empty one."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.schema, self.keys = T.StructType.fromJson(manifest.schema), manifest.keys

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType | str | None = None, keys: Sequence[str] = (), buckets: int = BUCKETS) -> KeyedTable:
        """The newest version; with a schema and keys an empty first version where there is none."""
        files = _Files(spark, path)
        versions = sorted(n for n in files.names("manifest") if n.endswith(".json"))
        if versions:
            return cls(spark, path, Manifest.of(files.read(f"manifest/{versions[-1]}")))
        if schema is None or not keys:
            raise FileNotFoundError(path)
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
        first = Manifest(0, buckets, list(keys), fields.jsonValue())
        files.put_once("manifest/00000000000000000000.json", first.text())  # who comes second finds the first one's
        return cls.open(spark, path)

    @property
    def version(self) -> int:
        return self.manifest.version

    def _read(self, files: Sequence[str]) -> DataFrame:
        names = [f"{self.path}/{f}" for f in files]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the version that was opened."""
        return self._read([f for b in sorted(self.manifest.files) for f in self.manifest.files[b]])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast(self.schema[k].dataType) for k in self.keys)), F.lit(self.manifest.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        return sorted(r[0] for r in batch.select(self.bucket().alias(_BUCKET)).distinct().collect())  # at most `buckets` numbers

    def rows_of(self, buckets: Sequence[int]) -> DataFrame:
        return self._read([f for b in buckets for f in self.manifest.files.get(b, ())])

    def _commit(self, rows: DataFrame, buckets: Sequence[int], replace: bool) -> KeyedTable:
        folder = f"data/{self.version + 1:020d}-{uuid.uuid4().hex}"
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn(_BUCKET, self.bucket())
        shaped.repartition(max(1, len(buckets)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        files, live = _Files(self.spark, self.path), {b: list(f) for b, f in self.manifest.files.items()}
        for name in files.names(folder):
            if name.startswith(f"{_BUCKET}="):
                b = int(name.partition("=")[2])
                new = [f"{folder}/{name}/{n}" for n in files.names(f"{folder}/{name}") if n.endswith(".parquet")]
                live[b] = new if replace else live.get(b, []) + new
        if not replace and live == self.manifest.files:
            return self
        if replace:
            written = {int(n.partition("=")[2]) for n in files.names(folder) if n.startswith(f"{_BUCKET}=")}
            for b in set(buckets) - written:
                live.pop(b, None)
        new = Manifest(self.version + 1, self.manifest.buckets, self.keys, self.manifest.schema, live)
        if not files.put_once(f"manifest/{new.version:020d}.json", new.text()):
            raise Conflict(f"version {new.version} of {self.path} is another writer's; this write started from {self.version}")
        return KeyedTable(self.spark, self.path, new)

    def rewrite(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> KeyedTable:
        """The next version: change(old rows, batch) in the buckets that the batch touches. Give a stored batch, it is read twice."""
        buckets = self.touched(batch)
        return self._commit(change(self.rows_of(buckets), batch), buckets, replace=True) if buckets else self

    def merge(self, batch: DataFrame, update: Sequence[str] = (), coalesce: Sequence[str] = (), set_to: Mapping[str, Column] | None = None, order: Sequence[str] = ()) -> KeyedTable:
        """Upsert (`ledger.upsert`): `update` columns take the batch's value, `coalesce` columns unless it is NULL. With `order`, the first row
        of each key counts; without it, a batch with two rows of one key is refused."""
        if order:
            batch = first_of_key(batch, self.keys, order)
        elif not batch.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("the batch has several rows of one key: give an order")
        return self.rewrite(batch, lambda old, new: upsert(old, new, self.keys, update, coalesce, set_to))

    def insert(self, batch: DataFrame, order: Sequence[str]) -> tuple[KeyedTable, DataFrame]:
        """The next version with the first row, by `order`, of each key that is not there; and the batch's rows whose key was there. Files
        are added, none is rewritten. Without a new key the version stays."""
        buckets = self.touched(batch)
        new, existing = insert_if_absent(self.rows_of(buckets), batch, self.keys, order)
        return (self._commit(new, buckets, replace=False) if buckets else self), existing

    def vacuum(self, keep: int = 1) -> int:
        """Removes data folders that none of the newest `keep` versions names, and older manifests. Only where no reader of an old version and
        no writer is left. Gives the number of folders removed."""
        files = _Files(self.spark, self.path)
        versions = sorted(n for n in files.names("manifest") if n.endswith(".json"))
        live = {f.split("/")[1] for n in versions[-keep:] for held in Manifest.of(files.read(f"manifest/{n}")).files.values() for f in held}
        gone = [n for n in files.names("data") if n not in live]
        for n in gone:
            files.fs.delete(files.path(f"data/{n}"), True)
        for n in versions[:-keep]:
            files.fs.delete(files.path(f"manifest/{n}"), False)
        return len(gone)
