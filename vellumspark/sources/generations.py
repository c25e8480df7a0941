"""Tables that change by generations (D-5, T-16, T-17): new files are written beside the old, then one manifest makes them current.

A manifest is a small JSON file, numbered, put in its place by a rename that never replaces another one: two writers can't
both publish a number, and a reader sees the old table or the new one. What fails before the rename changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Manifests:
    """The numbered manifests of a folder in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.Path(self.path).getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/_manifests/{name}")

    def numbers(self) -> list[int]:
        folder = self.jvm.Path(f"{self.path}/_manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._at(f"{number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def publish(self, number: int, content: dict) -> None:
        """Make content the manifest of a number; raises if there is one of that number."""
        made = self._at(f"{uuid.uuid4().hex}.tmp")
        out = self.fs.create(made, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        rename = getattr(self.jvm, "Options$Rename")
        context = self.jvm.FileContext.getFileContext(made.toUri(), self.conf) if made.toUri().getScheme() else self.jvm.FileContext.getFileContext(self.conf)
        context.rename(made, self._at(f"{number:08d}.json"), self.spark.sparkContext._gateway.new_array(rename, 0))

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.Path(path), True)


class Generations:
    """A table in buckets of a key's hash. ``replace`` writes only the buckets of the keys that change, and publishes them together."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.manifests = Manifests(spark, path)
        _, now = self.manifests.latest()
        self.buckets = now["buckets"] if now else buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current table, or some of its buckets."""
        _, now = self.manifests.latest()
        if now is None:
            raise ValueError(f"{self.path} holds no table yet")
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{self.path}/{p}" for b, p in now["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, new: DataFrame, keys: DataFrame | None = None) -> int:
        """Rows of new take the place of all rows of their keys, or of the keys given, which may have no new rows. Returns the generation's number.

        Null keys are a key. New rows of other keys than those given are an error of the caller and are left out.
        """
        number, now = self.manifests.latest()
        keys = (new if keys is None else keys).select(F.col(self.key).alias("_key")).distinct()
        of_key = F.col(self.key).eqNullSafe(F.col("_key"))
        touched = sorted(r[0] for r in keys.select(F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int")).distinct().collect())  # at most ``buckets``
        if not touched and now is not None:
            return number
        rows = new.join(keys, of_key, "left_semi")
        if now is not None:
            old = self.read(touched)
            rows = old.join(keys, of_key, "left_anti").unionByName(rows.select(*old.columns))
        part = f"g{number + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{part}")
        made = self._written(f"{self.path}/{part}")
        files = {} if now is None else {b: p for b, p in now["files"].items() if int(b) not in touched}
        files |= {str(b): f"{part}/_bucket={b}" for b in touched if b in made}
        schema = now["schema"] if now else T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]).jsonValue()
        self.manifests.publish(number + 1, {"key": self.key, "buckets": self.buckets, "schema": schema, "files": files})
        return number + 1

    def _written(self, folder: str) -> set[int]:
        fs, path = self.manifests.fs, self.manifests.jvm.Path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return {int(n.split("=")[1]) for n in names if n.startswith("_bucket=")}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what none of the last ``keep`` manifests names: older manifests, replaced files and those of failed writes."""
        numbers = self.manifests.numbers()
        kept = {p.split("/")[0]: True for n in numbers[-keep:] for p in self.manifests.read(n)["files"].values()}
        live = {p for n in numbers[-keep:] for p in self.manifests.read(n)["files"].values()}
        fs, gone = self.manifests.fs, []
        for s in fs.listStatus(self.manifests.jvm.Path(self.path)):
            name = s.getPath().getName()
            if name == "_manifests":
                continue
            if name not in kept:
                gone.append(name)
            else:
                gone += [f"{name}/_bucket={b}" for b in sorted(self._written(f"{self.path}/{name}")) if f"{name}/_bucket={b}" not in live]
        for g in gone:
            self.manifests.delete(f"{self.path}/{g}")
        for n in numbers[:-keep]:
            self.manifests.delete(f"{self.path}/_manifests/{n:08d}.json")
        return gone
