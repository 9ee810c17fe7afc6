"""Word counts over a growing folder of texts.

Counts of each batch are written to a folder of their own, under the id of the query's checkpoint, and
added up when read. A batch that runs again after a failure replaces its folder, so nothing is
counted twice, and no state grows with the vocabulary. A query with a new checkpoint would count
all files again, so it refuses a folder that holds another query's counts.

Ten batches are merged into one folder, ten such into one of the next level, and so on. A merge writes
its folder first and then a record of which batches it holds; readers follow the records, so a merge that
was cut short leaves litter but nothing counted twice, and is done again. A thousand batches are read as
one folder, and each count is written once per level.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from countylens import storage
from countylens.operators import words
from countylens.sources.readers import _file_state

COUNTS = "state string, word string, count bigint"
# Folders that become one of the next level.
FOLD = 10
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a folder's files by state, as they appear."""
    return spark.readStream.text(folder).select(_file_state().alias("state"),
                                                F.col("value").alias("text"))


def running_counts(texts: DataFrame) -> DataFrame:
    """Counts kept in stream state, for ``update`` or ``complete`` sinks."""
    return words.word_counts(words.words(texts, keep=("state",)), by=("state",))


@contextmanager
def _state_on_disk(spark: SparkSession):
    """Queries started meanwhile keep their state in RocksDB on the executors' disks, with bounded memory."""
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    for k, v in STATE_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def start_running(texts: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                  every: str = "1 minute") -> StreamingQuery:
    """Counts kept in stream state, written whole to ``out`` after each batch; ``running_so_far`` reads them.

    State lies on disk and counts go from the executors to the store, so neither is bound by a heap. The
    folder before the newest stays for readers that are at work.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        for earlier in _whole(batch.sparkSession, out):
            if earlier < batch_id - 1:
                storage.remove(batch.sparkSession, f"{out}/batch={earlier}")

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    with _state_on_disk(texts.sparkSession):
        return (running_counts(texts).writeStream.outputMode("complete").foreachBatch(write_batch)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _whole(spark: SparkSession, out: str) -> list[int]:
    """The batches whose counts are written to the end, in order."""
    return sorted(int(n[6:]) for n in storage.names(spark, out)
                  if n.startswith("batch=") and storage.exists(spark, f"{out}/{n}/_SUCCESS"))


def running_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The counts of ``start_running`` after its newest batch."""
    found = _whole(spark, out)
    if not found:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{out}/batch={found[-1]}")


def start(texts: DataFrame, out: str, checkpoint: str, available_now: bool = True,
          every: str = "1 minute") -> StreamingQuery:
    """Counts each batch into ``out``."""
    counted = words.words(texts, keep=("state",))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        others = [q for q in _queries(spark, out) if q != query]
        if others:
            raise ValueError(f"{out} holds counts of another query: {others}")
        (words.word_counts(batch, by=("state",))
         .write.mode("overwrite").parquet(f"{out}/query={query}/batch={batch_id}"))
        merge(spark, out, query, batch_id + 1)

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (counted.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _queries(spark: SparkSession, out: str) -> list[str]:
    """Ids of the queries that have written counts to a folder."""
    return [n.removeprefix("query=") for n in storage.names(spark, out) if n.startswith("query=")]


def _merged(spark: SparkSession, out: str, query: str) -> list[tuple[int, int]]:
    """The recorded merges: the first batch, and the one behind the last."""
    records = [n for n in storage.names(spark, f"{out}/query={query}/merged") if n.endswith(".json")]
    return [tuple(map(int, n.removesuffix(".json").split("-"))) for n in records]


def _live(spark: SparkSession, out: str, query: str, behind: int | None = None) -> list[tuple[int, int, str]]:
    """The folders that hold each batch once, in order, with the batches they hold: the largest merges,
    and the batches in none. With ``behind``, only those that hold no batch from there on."""
    home = f"{out}/query={query}"
    units = [(int(n[6:]), int(n[6:]) + 1, None) for n in storage.names(spark, home) if n.startswith("batch=")]
    units += [(a, b, f"{home}/merged/{a}-{b}.json") for a, b in _merged(spark, out, query)]
    live, at = [], -1
    for first, end, record in sorted(units, key=lambda u: (u[0], -u[1])):
        if first >= at and (behind is None or end <= behind):
            folder = f"merged/{storage.record(spark, record)['folder']}" if record else f"batch={first}"
            live.append((first, end, f"{home}/{folder}"))
            at = end
    return live


def merge(spark: SparkSession, out: str, query: str, behind: int) -> None:
    """Merge what is whole of the batches before ``behind``, level by level."""
    size = FOLD
    while size <= behind:
        done = _merged(spark, out, query)
        for first in range(0, behind - size + 1, size):
            if any(a <= first and b >= first + size for a, b in done):
                continue
            parts = [f for a, b, f in _live(spark, out, query, first + size) if a >= first]
            folder = f"{first}-{first + size}-{uuid.uuid4().hex}"
            place = f"{out}/query={query}/merged"
            _added(spark, parts).write.parquet(f"{place}/{folder}")
            storage.put_record(spark, f"{place}/{first}-{first + size}.json",
                               {"first": first, "behind": first + size, "folder": folder})
        size *= FOLD


def clean(spark: SparkSession, out: str) -> None:
    """Remove batches and merges that larger merges hold, and what cut-short merges left. Only safe while
    no batch is being written and no reader of older folders is at work."""
    for query in _queries(spark, out):
        home, live = f"{out}/query={query}", {f for *_, f in _live(spark, out, query)}
        for name in storage.names(spark, home):
            if name.startswith("batch=") and f"{home}/{name}" not in live:
                storage.remove(spark, f"{home}/{name}")
        for name in storage.names(spark, f"{home}/merged"):
            if not name.endswith(".json") and f"{home}/merged/{name}" not in live:
                storage.remove(spark, f"{home}/merged/{name}")


def compact(spark: SparkSession, out: str, into: str) -> None:
    """All counts so far, summed up, in a folder of their own."""
    counts_so_far(spark, out).write.mode("overwrite").parquet(into)


def counts_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all batches, read from the newest merges and the batches after them."""
    return _added(spark, [f for q in _queries(spark, out) for *_, f in _live(spark, out, q)])


def _added(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(*folders).groupBy("state", "word").agg(F.sum("count").alias("count"))
