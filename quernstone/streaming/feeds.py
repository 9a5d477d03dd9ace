"""Tables kept up to date from a feed of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.tables import shared_dir


def debounced(changes: DataFrame, key: str = "path", at: str = "ts", gap: str = "1 second", late: str = "1 minute") -> DataFrame:
    """One row per run of changes of a key with less than ``gap`` between them: the last one, and how many they were.

    Works on a stream and on a table; on a stream rows later than ``late`` are dropped.
    """
    source = changes.withWatermark(at, late) if changes.isStreaming else changes
    rest = [c for c in changes.columns if c not in (key, at)]
    last = F.max_by(F.struct(at, *rest), F.struct(at, *rest)).alias("last")
    return source.groupBy(key, F.session_window(at, gap).alias("w")).agg(last, F.count("*").alias("changes")).select(key, "last.*", "changes")


def merged(held: DataFrame | None, changes: DataFrame, key: str, version: str, op: str | None = None) -> DataFrame:
    """The newest row of each key; one whose ``op`` is delete stays as a mark against late rows, and readers leave it out.

    Of equal versions a delete counts first, then the greater row, so a batch that is run twice changes nothing.
    """
    both = changes if held is None else held.unionByName(changes, allowMissingColumns=True)
    row = F.struct(version, *[c for c in both.columns if c not in (key, version)])
    gone = [F.coalesce(F.col(op) == "delete", F.lit(False)).alias("gone")] if op else []
    order = F.struct(F.col(version).alias("v"), *gone, row.alias("row"))
    return both.groupBy(key).agg(F.max_by(row, order).alias("r")).select(key, "r.*").select(*both.columns)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the files of the table ``name``, which is a file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def renames(changes: DataFrame, key: str = "path", old: str = "old_path", op: str = "op") -> DataFrame:
    """A rename as two changes: the old key is deleted, the new one is written; the column ``old`` goes."""
    gone = F.struct(F.col(old).alias("k"), F.lit("delete").alias("o"))
    new = F.struct(F.col(key).alias("k"), F.when(F.col(op) == "rename", "modify").otherwise(F.col(op)).alias("o"))
    both = F.when((F.col(op) == "rename") & F.col(old).isNotNull(), F.array(gone, new)).otherwise(F.array(new))
    rows = changes.withColumn("_e", F.explode(both)).withColumns({key: F.col("_e.k"), op: F.col("_e.o")})
    return rows.select(*[c for c in changes.columns if c != old])


class KeptTable:
    """A table in buckets of its key; a batch of a stream writes a version of the buckets it touches.

    ``op``: the column whose value "delete" takes a key out; such rows are kept
    as marks against late changes, and ``read`` leaves them out. A version
    counts once it is written as a whole: a batch that is run again after a
    failure reads the versions before it, one that was written is skipped, and
    a new session goes on from what lies in the folder.
    """

    def __init__(self, spark: SparkSession, key: str, version: str, folder: str | None = None, op: str | None = None, buckets: int = 16):
        self.spark, self.key, self.version, self.op, self.buckets = spark, key, version, op, buckets
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"

    def _names(self, at: str) -> list[str]:
        """The names in a folder of the table; none where it is not there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The newest whole version of each bucket, of those before ``below``."""
        out: dict[int, int] = {}
        for v in sorted(int(n[1:]) for n in self._names(self.folder) if n[0] == "v" and n[1:].isdigit()):
            if below is None or v < below:
                names = self._names(f"{self.folder}/v{v}")
                if "_SUCCESS" in names:
                    out |= {int(n.partition("=")[2]): v for n in names if n.startswith("bucket=")}
        return out

    def _held(self, at: dict[int, int]) -> DataFrame | None:
        if not at:
            return None
        return self.spark.read.parquet(*[f"{self.folder}/v{v}/bucket={b}" for b, v in sorted(at.items())])

    def apply(self, changes: DataFrame, batch: int) -> None:
        if "_SUCCESS" in self._names(f"{self.folder}/v{batch}"):
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r.b for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
        held = self._held({b: v for b, v in self.versions(batch).items() if b in touched})
        new = merged(held, changes, self.key, self.version, self.op)
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{batch}")

    def read(self) -> DataFrame:
        held = self._held(self.versions())
        if held is None:
            raise FileNotFoundError(f"nothing was written to {self.folder} yet")
        return held.where((F.col(self.op) != "delete") | F.col(self.op).isNull()) if self.op else held

    def follow(self, stream: DataFrame) -> None:
        """All that the source has now, in order, then back."""
        write = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True)
        write.start().awaitTermination()


def expired(cache: DataFrame, now, at: str = "cached_at", ttl: str = "60 minutes") -> DataFrame:
    """The rows of a cache that are older than ``ttl`` at ``now``; a null time counts as old."""
    return cache.where(F.col(at).isNull() | (F.col(at) + F.expr(f"interval {ttl}") <= F.lit(now).cast("timestamp")))


def document_counts(held: DataFrame | None, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """token, df after texts came and went: ``added`` and ``removed`` have a row per text and token."""
    parts = [added.groupBy("token").agg(F.count("*").alias("df"))]
    if removed is not None:
        parts.append(removed.groupBy("token").agg((-F.count("*")).alias("df")))
    if held is not None:
        parts.append(held.select("token", "df"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
