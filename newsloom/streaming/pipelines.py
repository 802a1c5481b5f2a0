"""Structured Streaming forms: windows and sessions with watermarks, dedupe, commit after delivery.

Event time columns without zone are cast to timestamps first, as watermarks need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from newsloom.operators.state import remember, unseen
from newsloom.session import own_dir


def event_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, ts: str, keys: list[str], within: str = "72 hours") -> DataFrame:
    """Each key once while it keeps coming within the time: the stream's form of a bounded seen set."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


#: State is kept on the executors' disks, with so many MB of memory an executor, as a heap holds only so many keys.
_STATE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "200", "rocksdb.compression": "zstd"}


def _start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts the stream with ``_STATE``; a stream copies the session's settings as it starts, so they are put back at once."""
    new = {f"spark.sql.streaming.stateStore.{k}": v for k, v in _STATE.items()}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(out: DataFrame, spark: SparkSession, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All data there is, then stop; the result as a table under the shared folder, whose rows don't pass the driver."""
    path = f"{own_dir(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def keep(batch: DataFrame, number: int) -> None:  # a complete result takes the place of the one before; a batch that is repeated, of itself
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/{number:08d}")

    q = _start(out.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark)
    q.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(path)


class SeenStore:
    """Seen ids as a table, one version a commit; a batch that was delivered whole isn't delivered again.

    A version's folder is named by its number, its batch and whether that was delivered ``whole`` or in ``part``.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, most: int = 8_000):
        self.spark, self.folder, self.key, self.most = spark, folder, key, most
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, int, str]]:
        """Version, batch and extent of each finished commit, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath() for f in self._fs.listStatus(self._path(self.folder))]
        found = [p.getName().split("-") for p in names if p.getName().count("-") == 2 and self._fs.exists(self._path(p, "_SUCCESS"))]
        return sorted((int(v), int(b), extent) for v, b, extent in found)

    def versions(self) -> list[int]:
        return sorted(b for _, b, extent in self.commits() if extent == "whole")

    def load(self) -> DataFrame:
        found = self.commits()
        if not found:
            return self.spark.createDataFrame([], f"{self.key} string, seq long")
        version, batch, extent = found[-1]
        return self.spark.read.parquet(f"{self.folder}/{version:08d}-{batch}-{extent}")

    def _commit(self, rows: DataFrame, batch_id: int, seq: str, extent: str) -> None:
        told = rows.select(F.col(self.key).cast("string").alias(self.key), F.col(seq).cast("long").alias("seq"))
        version = max((v for v, _, _ in self.commits()), default=-1) + 1
        remember(self.load(), told, self.key, "seq", self.most).write.mode("overwrite").parquet(f"{self.folder}/{version:08d}-{batch_id}-{extent}")

    def deliver(self, batch: DataFrame, batch_id: int, sink: Callable[[DataFrame], bool], seq: str, dry_run: bool = False) -> bool:
        """Unseen rows go to the sink; only if it takes them are they remembered, and never in a dry run."""
        if batch_id in self.versions():
            return False
        fresh = unseen(batch, self.load(), self.key)
        if not sink(fresh) or dry_run:
            return False
        self._commit(fresh, batch_id, seq, "whole")
        return True

    def deliver_messages(self, batch: DataFrame, batch_id: int, compose: Callable[[DataFrame], DataFrame], sink: Callable[[str], bool], seq: str, dry_run: bool = False) -> bool:
        """Unseen rows go out as messages (``compose``: ``batch, text, items``), one after another until one isn't taken.

        What was taken is remembered even then; the batch counts as delivered only if all of it was, so a repeated
        run sends the rest. Rows that no message holds (an overflow) stay eligible. Messages are few; they pass the driver.
        """
        if batch_id in self.versions():
            return False
        fresh = unseen(batch, self.load(), self.key)
        messages = compose(fresh).orderBy("batch")
        told, whole = [], True
        if not dry_run:
            for m in messages.toLocalIterator():
                if not sink(m["text"]):
                    whole = False
                    break
                told += [(str(i),) for i in m["items"]]
        if dry_run or (not told and not whole):
            return False
        ids = self.spark.createDataFrame(told, "_told string")
        self._commit(fresh.join(ids, F.col(self.key).cast("string") == F.col("_told"), "left_semi"), batch_id, seq, "whole" if whole else "part")
        return whole


def deliver_stream(events: DataFrame, store: SeenStore, sink: Callable[[DataFrame], bool], seq: str, checkpoint: str) -> None:
    """``foreachBatch`` with commit after delivery, over all data there is."""
    q = events.writeStream.foreachBatch(lambda df, i: store.deliver(df, i, sink, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
