"""Exact duplicates by a stateful stream: state on disk, keyed by digest and without expiry; full bytes are compared on hits.

The table's files are a stream. For each digest the state has how many rows
there were, the largest id, and where that row lies (its file and its place in
it). Files added later are taken up by another ``update`` with the same folder,
and hit what earlier ones left. Rows of a digest are summed in each task before
they move, so a text of which there are millions is a row a task.

Rows of a digest that has more than one are hits; only their texts are read
again and compared whole. A digest of different texts, should there be one, is
counted anew by its texts.

Defined results: a null text counts as empty; nothing else is changed before
texts are compared, and whole texts count, however long. Of equal texts the row
with the largest id stays; a null id is less than any; of rows with equal ids
the one whose file's name, and then its place in it, is last. An empty table
gives an empty result. Of other columns, whatever their names, ``members``
reads none and ``keep_one`` keeps all. Files must not be changed once they are taken up.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.filters import MOST_BITS, may_be_among
from strandline.llm.storage import shared_folder, written

#: State is kept by RocksDB on executors' disks, with changes written to the shared folder.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Space for logs that is taken beforehand is much where there are many small stores.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


@dataclass(frozen=True)
class ExactConfig:
    #: From the bytes of a text to its digest.
    digest: object = sha256
    #: Input of one batch of the stream; a batch is a job of its own and the unit of recovery.
    batch_bytes: int = 1 << 40
    #: Most bits of the filter that tells which rows may be hits; 16 MB.
    filter_bits: int = MOST_BITS


@contextmanager
def _state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _content() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def update(spark: SparkSession, path: str, folder: str, config: ExactConfig = ExactConfig()) -> None:
    """Takes up the Parquet files at ``path`` that ``folder`` hasn't yet; ends when all are."""
    schema = spark.read.parquet(path).schema
    # A pattern may name a single file as well as a folder of files.
    path = f"{path[:-1]}[{path[-1]}]"
    options = {"maxBytesPerTrigger": str(config.batch_bytes), "maxFileAge": "36500d"}
    rows = spark.readStream.schema(schema).options(**options).parquet(path)
    rows = rows.select(config.digest(_content()).alias("digest"), F.struct("doc_id", _place().alias("place")).alias("row"))
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("row").alias("last"))
    with _state_settings(spark):
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    stream.awaitTermination()


def held(spark: SparkSession, folder: str) -> DataFrame:
    """``digest, n, last`` of the state."""
    with _state_settings(spark):
        state = spark.read.format("statestore").load(folder)
    return state.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("last"))


def members(spark: SparkSession, path: str, folder: str, config: ExactConfig = ExactConfig()) -> DataFrame:
    """``doc_id, place, digest, n, last`` for every row: how many rows have its text, and id and place of the one that stays."""
    rows = spark.read.parquet(path).select("doc_id", "text", "_metadata")
    rows = rows.select("doc_id", _place().alias("place"), config.digest(_content()).alias("digest"), _content().alias("content"))
    groups = written(held(spark, folder))
    hits = groups.where("n > 1").select("digest")
    suspects = may_be_among(hits, "digest", config.filter_bits)(rows)
    # Copies within a task are compared there; one of them moves.
    contents = suspects.select("digest", "content").distinct().join(hits, "digest", "left_semi")
    mixed = written(contents.groupBy("digest").count().where("count > 1").select("digest"))
    plain = rows.drop("content").join(groups, "digest")
    if mixed.isEmpty():
        return plain.select("doc_id", "place", "digest", "n", "last")
    again = suspects.join(mixed, "digest")
    exact = again.groupBy("digest", "content").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "place")).alias("last"))
    by_content = again.join(exact, ["digest", "content"])
    out = [df.select("doc_id", "place", "digest", "n", "last") for df in (plain.join(mixed, "digest", "left_anti"), by_content)]
    return out[0].union(out[1])


def duplicates(spark: SparkSession, path: str, config: ExactConfig = ExactConfig()) -> DataFrame:
    """``members`` of a table by a state of its own."""
    folder = shared_folder(spark)
    update(spark, path, folder, config)
    return members(spark, path, folder, config)


def keep_one(docs: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """One row of each text of ``docs``, the one with the largest id; columns as they are."""
    numbered = written(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    path = numbered.inputFiles()
    if not path:
        return docs.limit(0)
    folder = path[0].rsplit("/", 1)[0]
    found = duplicates(docs.sparkSession, folder, config)
    kept = found.where(F.col("place") == F.col("last.place")).select("place")
    placed = docs.sparkSession.read.schema(numbered.schema).parquet(folder).select("doc", _place().alias("place"))
    return placed.join(kept, "place", "left_semi").select("doc.*")
