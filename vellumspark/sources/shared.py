"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a temporary folder and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


TEXT_BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts have 4 MB instead of up to 64: workers hold a few of them at a time.

    The setting is the session's and stays, as plans run after the operator has returned; smaller values are kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df in parts of about so many rows, counted first: for work that is large against a row's bytes, as files are split by bytes alone."""
    return df.repartition(max(1, -(-df.count() // rows)))


_made: list[tuple[str, DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as compressed Parquet in the shared folder and read it again.

    Lost executors lose nothing of it, and its readers see one and the same content. The folder stays until a Scratch
    around the call or drop_written() deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made.append((path, out))
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that written() made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete the folders of these frames, which nothing reads any more; frames that written() didn't return are passed over."""
    for path, df in [x for x in _made if any(x[1] is f for f in frames)]:
        drop_path(df.sparkSession, path)
        _made.remove((path, df))


class Scratch:
    """Deletes at its end, unless an error leaves it, what written() has made inside, but for what kept frames read."""

    def __enter__(self) -> Scratch:
        self.old, self.kept = len(_made), []
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, error, *_) -> None:
        if error is None:
            read = [f for k in self.kept for f in k.inputFiles()]
            drop_written(*[df for path, df in _made[self.old :] if not any(path.rsplit("/", 1)[1] in f for f in read)])
