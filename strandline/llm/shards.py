"""Resharding with the fewest bytes moved, by minimum-cost flow.

Old shards send their bytes to new shards of given capacities. Staying costs
nothing and moving costs one a byte, so a cheapest flow moves the fewest. The
flow is found on shard sizes alone. Each old shard, in the order of its files
and their rows, is then cut where the flow says; that leaves a table of a few
ranges for each file, by which the rows of affected files are written anew.
Files whose rows all stay are left as they are. Texts are never shuffled.

Defined results: a null text has no bytes; each row counts one more, so empty
texts have size 1. Rows with equal ids, or without one, are separate rows, and
equal sizes keep the order of the files. A null old shard counts as shard 0.
Shards without rows are possible; an empty table gives an empty result. Columns
are kept whatever their names, as a document is one column ``doc`` of the
files. Whole texts count, however long.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.llm.storage import discard, shared_folder, written


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 16
    #: Rows of a file whose sizes one task adds up; a range of rows lies in one such chunk.
    chunk_rows: int = 1 << 16


def cheapest_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> list[list[int]]:
    """How much each supply sends to each capacity, all of it and as cheaply as can be.

    Successive shortest paths over the two sides; the graph has one node for
    each shard, however much data there is.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold what the old ones have")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    ends: list[int] = []
    room: list[int] = []
    price: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, most: int, each: int) -> None:
        for x, y, r, p in ((a, b, most, each), (b, a, 0, -each)):
            at[x].append(len(ends))
            ends.append(y)
            room.append(r)
            price.append(p)

    for i in range(n):
        link(source, i, supply[i], 0)
    for j in range(m):
        link(n + j, sink, capacity[j], 0)
    first = len(ends)
    for i in range(n):
        for j in range(m):
            link(i, n + j, supply[i], cost(i, j))
    while True:
        best: list[float] = [float("inf")] * (n + m + 2)
        by = [-1] * (n + m + 2)
        best[source] = 0
        waiting = deque([source])
        while waiting:
            x = waiting.popleft()
            for e in at[x]:
                if room[e] and best[x] + price[e] < best[ends[e]]:
                    best[ends[e]], by[ends[e]] = best[x] + price[e], e
                    waiting.append(ends[e])
        if by[sink] < 0:
            break
        path = []
        x = sink
        while x != source:
            path.append(by[x])
            x = ends[by[x] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    return [[room[first + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _place() -> list[Column]:
    """Where a row stands: its shard's folder, its file there, and its place in the file."""
    return [F.col("shard").alias("old"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]


def _chunk(config: ShardConfig) -> Column:
    return F.floor(F.col("at") / config.chunk_rows).cast("long").alias("chunk")


def _size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit("")).cast("binary")) + 1).cast("long")


def write_shards(docs: DataFrame, old_shard: Column, path: str, config: ShardConfig = ShardConfig()) -> None:
    """Writes ``docs`` as files of column ``doc`` under ``path/shard=<n>``; ``old_shard`` is of the columns of ``docs``."""
    shard = F.pmod(F.coalesce(old_shard, F.lit(0)), F.lit(config.shards)).cast("int")
    docs.select(F.struct(*docs.columns).alias("doc"), shard.alias("shard")).write.partitionBy("shard").parquet(path)


def _read(spark: SparkSession, path: str, doc: StructType, *more: str) -> DataFrame:
    schema = StructType().add("doc", doc)
    for name in more:
        schema = schema.add(name, "long")
    return spark.read.schema(schema.add("shard", "integer")).parquet(path)


def assign(spark: SparkSession, path: str, doc: StructType, config: ShardConfig = ShardConfig(), capacities: list[int] | None = None) -> DataFrame:
    """``old, file, chunk, low, high, shard, slot, bytes``: to which shard the rows from ``low`` to ``high`` of a file go, the first to ``slot``.

    ``capacities`` in bytes are even ones unless given. A shard exceeds its
    capacity by less than a row for each old shard that it gets rows from. The
    driver gets the shards' sizes only.
    """
    files = _read(spark, path, doc)
    rows = written(files.select(*_place(), _size(F.col("doc.text")).alias("size")).withColumn("chunk", _chunk(config)))
    supply = [0] * config.shards
    for r in rows.groupBy("old").agg(F.sum("size").alias("size")).collect():
        supply[r["old"]] = r["size"]
    flow = cheapest_flow(supply, capacities or even_capacities(sum(supply), config.shards), lambda i, j: int(i != j))
    cuts = []
    for i, sent in enumerate(flow):
        upto, parts = 0, []
        for j in sorted(range(len(sent)), key=lambda j: (j != i, j)):  # what stays comes first
            if sent[j]:
                upto += sent[j]
                parts.append((upto, j))
        if parts:
            cuts.append((i, [(u if k < len(parts) - 1 else (1 << 62), j) for k, (u, j) in enumerate(parts)]))
    cut = spark.createDataFrame(cuts, "old int, cuts array<struct<upto: long, shard: int>>")
    # A row for each chunk of each file, so these windows are short whatever a shard's rows.
    before = Window.partitionBy("old").orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("old", "file", "chunk").agg(F.sum("size").alias("size"))
    starts = chunks.select("old", "file", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("old", "file", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("size").over(within) - F.expr("size div 2")
    placed = rows.join(starts, ["old", "file", "chunk"]).withColumn("middle", middle).join(F.broadcast(cut), "old")  # a row for each shard
    shard = F.element_at(F.filter("cuts", lambda c: c["upto"] > F.col("middle")), 1)["shard"]
    ranges = placed.groupBy("old", "file", "chunk", shard.alias("shard")).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum("size").alias("bytes"))
    order = Window.partitionBy("shard").orderBy("old", "file", "low").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(order), F.lit(0))
    out = written(ranges.withColumn("slot", slot))
    discard(rows)
    return out


def moved_bytes(ranges: DataFrame) -> DataFrame:
    """``old, shard, bytes`` for each transfer between different shards."""
    return ranges.where("old <> shard").groupBy("old", "shard").agg(F.sum("bytes").alias("bytes"))


def affected_files(ranges: DataFrame) -> DataFrame:
    """``old, file`` of the files that have rows which move."""
    return ranges.where("old <> shard").select("old", "file").distinct()


def _placed(spark: SparkSession, path: str, doc: StructType, ranges: DataFrame, config: ShardConfig) -> DataFrame:
    """``doc, old, new, slot`` of the rows of those files that ``ranges`` has."""
    rows = _read(spark, path, doc).select("doc", *_place()).withColumn("chunk", _chunk(config))
    # Few ranges a file: small enough to go to all tasks unless files are very many, which Spark decides.
    ranges = ranges.select("old", "file", "chunk", "low", "high", F.col("shard").alias("new"), "slot")
    return rows.join(ranges, ["old", "file", "chunk"]).where("at BETWEEN low AND high").select("doc", "old", "new", (F.col("slot") + F.col("at") - F.col("low")).alias("slot"))


def rewrite(spark: SparkSession, path: str, new_path: str, doc: StructType, ranges: DataFrame, config: ShardConfig = ShardConfig()) -> None:
    """Writes the rows of affected files under ``new_path/shard=<n>``, with columns ``doc, old, slot``; the old ones can go then."""
    affected = ranges.join(affected_files(ranges), ["old", "file"], "left_semi")
    rows = _placed(spark, path, doc, affected, config).withColumnRenamed("new", "shard").withColumn("old", F.col("old").cast("long"))
    rows.write.partitionBy("shard").parquet(new_path)


def read_shards(spark: SparkSession, path: str, new_path: str, doc: StructType, ranges: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """``doc, old, shard, slot`` of all rows: those of untouched files at ``path``, and those written anew."""
    untouched = ranges.join(affected_files(ranges), ["old", "file"], "left_anti")
    stay = _placed(spark, path, doc, untouched, config).withColumnRenamed("new", "shard")
    anew = _read(spark, new_path, doc, "old", "slot")
    return stay.unionByName(anew.select("doc", F.col("old").cast("int").alias("old"), "shard", "slot"))


def reshard(docs: DataFrame, old_shard: Column, config: ShardConfig = ShardConfig(), capacities: list[int] | None = None) -> DataFrame:
    """Writes ``docs`` as old shards, moves what must move, and reads all back: ``doc, old, shard, slot``."""
    spark, doc = docs.sparkSession, StructType(docs.schema.fields)
    path, new_path = shared_folder(spark), shared_folder(spark)
    write_shards(docs, old_shard, path, config)
    ranges = assign(spark, path, doc, config, capacities)
    rewrite(spark, path, new_path, doc, ranges, config)
    return read_shards(spark, path, new_path, doc, ranges, config)
