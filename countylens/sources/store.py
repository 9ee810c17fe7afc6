"""Tables of rows known by a key, appended in runs that can be repeated.

A run writes its rows to a folder of its own and then puts down a record that names it. Readers follow
the records, so a run that was killed has stored nothing, and its folder is litter; a run that is done is
known by its name and not done again. Records are numbered, and a run that finds its number taken
compares its rows anew with what the other run has stored.

Rows lie in hash buckets of the key. A later run finds its unseen keys by a join that shuffles the new rows only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from countylens import storage
from countylens.operators import tweets

BUCKETS = 512


def create(spark: SparkSession, path: str, schema: StructType, key: str = "id", buckets: int = BUCKETS) -> None:
    """An empty table. Buckets cannot be changed later; a bucket of one run is a file."""
    about = {"schema": schema.jsonValue(), "key": key, "buckets": buckets}
    if not storage.put_record(spark, f"{path}/about.json", about):
        raise ValueError(f"{path} holds a table already")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all recorded runs."""
    rows = _rows(spark, path)
    return rows.filter(F.col("run").isin(_live(_records(spark, path)))).drop("run")


def append(df: DataFrame, path: str, run: str) -> bool:
    """Store the rows whose key is not stored yet, once each. False if the named run was done before."""
    spark = df.sparkSession
    about = storage.record(spark, f"{path}/about.json")
    key, names = about["key"], [f["name"] for f in about["schema"]["fields"]]
    while True:
        done = _records(spark, path)
        if any(r["run"] == run for r in done):
            return False
        fresh = tweets.unseen(df.select(*names), read(spark, path), key)
        folder = _write(fresh, path, about)
        if _commit(spark, path, len(done), {"run": run, "folder": folder, "replaces": []}):
            return True


def merge(spark: SparkSession, path: str) -> None:
    """All runs in one folder, a file per bucket, so that reading opens few files. Runs stay known by name.

    A run recorded meanwhile is left as it is.
    """
    about = storage.record(spark, f"{path}/about.json")
    done = _records(spark, path)
    live = _live(done)
    if len(live) < 2:
        return
    folder = _write(read(spark, path), path, about)
    number = len(done)
    while not _commit(spark, path, number, {"run": None, "folder": folder, "replaces": live}):
        number += 1


def clean(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders no reader follows. Only safe while no run is under way and no old reader at work."""
    live = {f"run={f}" for f in _live(_records(spark, path))}
    litter = [n for n in storage.names(spark, f"{path}/rows") if n.startswith("run=") and n not in live]
    for name in litter:
        storage.remove(spark, f"{path}/rows/{name}")
    return litter


def runs(spark: SparkSession, path: str) -> list[str]:
    """The names of the runs that are done, in order."""
    return [r["run"] for r in _records(spark, path) if r["run"] is not None]


def _records(spark: SparkSession, path: str) -> list[dict]:
    done = [n for n in storage.names(spark, f"{path}/runs") if n.endswith(".json")]
    return [storage.record(spark, f"{path}/runs/{n}") for n in done]


def _commit(spark: SparkSession, path: str, number: int, record: dict) -> bool:
    return storage.put_record(spark, f"{path}/runs/{number:09d}.json", record)


def _live(records: list[dict]) -> list[str]:
    gone = {f for r in records for f in r["replaces"]}
    return [r["folder"] for r in records if r["folder"] not in gone]


def _table(spark: SparkSession, path: str) -> str:
    """The name under which this session knows the folder as a bucketed table."""
    about = storage.record(spark, f"{path}/about.json")
    name = f"rows_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        schema = StructType.fromJson(about["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        place = f"{path}/rows".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}, run STRING) USING parquet PARTITIONED BY (run) "
                  f"CLUSTERED BY (`{about['key']}`) SORTED BY (`{about['key']}`) INTO {about['buckets']} BUCKETS "
                  f"LOCATION '{place}'")
    if spark.conf.get("spark.sql.catalogImplementation") == "hive":
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return name


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_table(spark, path))


def _write(rows: DataFrame, path: str, about: dict) -> str:
    """The rows in a new folder, a file per bucket."""
    folder, key, buckets = uuid.uuid4().hex, about["key"], about["buckets"]
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # as the writer has it
    (rows.repartition(buckets, bucket).withColumn("run", F.lit(folder)).write.format("parquet").mode("append")
     .partitionBy("run").bucketBy(buckets, key).sortBy(key).saveAsTable(_table(rows.sparkSession, path)))
    return folder
