"""Exact top-k search by inner product, with distributed histogram selection.

Queries are taken in blocks of a fixed size; each block is scored against every
candidate in one pass, and its results are appended to one folder. Histograms of the scores, summed over all tasks, show in which bin
each query's k-th score lies; that bin is refined until few candidates are left
or it holds one value. Only then are candidates collected, by score and id.

Defined results: vectors that are null, empty, or hold a null or a number that
is not finite take no part, nor do rows without an id. A query's own row is any
row with its id; a query id that is there twice counts once. Only vectors of the
query's length are its candidates. Fewer than k candidates are all given. Ties
go to the smaller id. Scores are exact while they stay below 2**53. An empty table,
or one without queries, gives an empty result. Columns but the first two aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.storage import shared_folder


@dataclass(frozen=True)
class TopKConfig:
    k: int = 5
    scale: float = 256.0
    #: Queries of a pass over the candidates, which every task holds with a histogram each.
    query_rows: int = 16_384
    #: Queries and candidates whose scores are worked out at once.
    score_rows: int = 2048
    candidate_rows: int = 1024
    bins: int = 512
    #: A bin is not refined further when no more candidates than this reach it.
    few: int = 64


def _numbers(batch: pa.RecordBatch, scale: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-number vectors of the rows that take part."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero((lengths == length) & ids.is_valid().to_numpy(zero_copy_only=False))
    some = vectors.take(pa.array(at))
    flat = some.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), length)  # null becomes NaN
    good = np.isfinite(flat).all(axis=1)
    return ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False), np.floor(scale * flat[good])


def _scored(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, config: TopKConfig):
    """The place of the first of some queries, ids of some candidates, and their scores; a query's own row scores minus infinity."""
    for batch in batches:
        ids, vectors = _numbers(batch, config.scale, queries.shape[1])
        for a in range(0, len(ids), config.candidate_rows):
            some, across = ids[a : a + config.candidate_rows], vectors[a : a + config.candidate_rows].T
            for q in range(0, len(queries), config.score_rows):
                own_ids = query_ids[q : q + config.score_rows]
                scores = queries[q : q + config.score_rows] @ across
                place = np.clip(np.searchsorted(own_ids, some), 0, len(own_ids) - 1)
                own = np.flatnonzero(own_ids[place] == some)
                scores[place[own], own] = -np.inf
                yield q, some, scores


def _histograms(query: tuple, low: np.ndarray, high: np.ndarray, width: np.ndarray, config: TopKConfig):
    """For each query the count of scores by bin from ``low`` on, below ``high``, down to the bin that this task's k-th score is in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bins = len(low), config.bins
        counts = np.zeros(n * bins, dtype=np.int64)
        for q, _, scores in _scored(batches, *query.value, config):
            at = slice(q, q + len(scores))
            place = np.floor((scores - low[at, None]) / width[at, None])
            inside = (place >= 0) & (place < bins) & (scores < high[at, None])  # bins may reach past high
            base = (np.arange(len(scores)) * bins)[:, None]
            counts[q * bins : (q + len(scores)) * bins] += np.bincount((place + base)[inside].astype(np.int64), minlength=len(scores) * bins)
        table = counts.reshape(n, bins)
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
        q, b = np.nonzero((table > 0) & (above < config.k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(table[q, b], pa.int64())], ["query", "bin", "n"])

    return count


def _reaching(query: tuple, low: np.ndarray, config: TopKConfig):
    """The candidates from ``low`` on; of each query's no more than the best k of this task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        limit = 4 * config.k * max(1, len(low))

        def best(rows: list[np.ndarray]) -> list[np.ndarray]:
            q, ids, scores = rows
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            first = np.searchsorted(q, q, side="left")
            top = np.arange(len(q)) - first < config.k
            return [q[top], ids[top], scores[top]]

        for at, ids, scores in _scored(batches, *query.value, config):
            q, c = np.nonzero(scores >= low[at : at + len(scores), None])
            if len(q):
                kept = [np.concatenate([a, b]) for a, b in zip(kept, (q + at, ids[c], scores[q, c].astype(np.int64)), strict=True)]
                if len(kept[0]) > limit:
                    kept = best(kept)
        kept = best(kept)
        yield pa.RecordBatch.from_arrays([pa.array(query.value[0][kept[0]], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], ["query_id", "vec_id", "score"])

    return find


def _largest_norm(length: int, config: TopKConfig):
    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            vectors = _numbers(batch, config.scale, length)[1]
            most = max(most, float((vectors * vectors).sum(axis=1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return largest


def _search_block(candidates: DataFrame, block: pa.Table, length: int, norm: float, config: TopKConfig, path: str) -> None:
    """Appends ``query_id, rank, vec_id, score`` of a block of queries to ``path``."""
    spark = candidates.sparkSession
    parts = [p for b in block.to_batches() if len((p := _numbers(b, config.scale, length))[0])]
    if not parts:
        return
    ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ids, first = np.unique(ids, return_index=True)
    vectors = vectors[first]
    query = spark.sparkContext.broadcast((ids, vectors))  # at most query_rows vectors
    bound = np.ceil(np.sqrt((vectors * vectors).sum(axis=1)) * norm) + 1
    low, high = -bound, bound + 1  # the k-th score is in here, the end not included
    need = np.full(len(ids), config.k)
    going = np.ones(len(ids), dtype=bool)
    while going.any():
        width = np.maximum(1.0, np.ceil((high - low) / config.bins))
        ask_low = np.where(going, low, np.inf)  # nothing is counted for those that are done
        counted = candidates.mapInArrow(_histograms(query, ask_low, high, width, config), "query int, bin int, n long")
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        sums = counted.groupBy("query", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        wanted = spark.createDataFrame([(int(q), int(need[q])) for q in np.flatnonzero(going)], "query int, need long")
        reached = sums.join(F.broadcast(wanted), "query").where("upto >= need").groupBy("query")
        found = {r["query"]: r["at"] for r in reached.agg(F.max(F.struct("bin", "n", "upto")).alias("at")).collect()}
        for q in np.flatnonzero(going):
            at = found.get(int(q))
            if at is None:  # fewer candidates than asked for
                going[q] = False
                continue
            low[q] += at["bin"] * width[q]
            high[q] = min(high[q], low[q] + width[q])
            need[q] -= at["upto"] - at["n"]
            going[q] = width[q] > 1 and config.k - need[q] + at["n"] > config.few
    reaching = candidates.mapInArrow(_reaching(query, low, config), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    reaching.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= config.k).write.mode("append").parquet(path)
    query.destroy()


def exact_top_k(vectors: DataFrame, is_query: Column, config: TopKConfig = TopKConfig()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query among ``vectors`` (``vec_id, embedding``).

    Work is in proportion to queries times candidates; a query block is all that
    a task or the driver holds. Candidates are never shuffled.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = rows.where(F.col("vec_id").isNotNull() & is_query).withColumn("length", F.size("embedding")).where("length > 0")
    sizes = queries.groupBy("length").count().orderBy("length").collect()
    path = shared_folder(vectors.sparkSession)
    for length, count in [(r["length"], r["count"]) for r in sizes]:
        norm = rows.mapInArrow(_largest_norm(length, config), "most double").agg(F.max("most")).first()[0]
        blocks = -(-count // config.query_rows)
        dealt = queries.where(F.col("length") == length).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        # A block is read from its own files, not filtered out of all queries each time.
        dealt_path = shared_folder(vectors.sparkSession)
        dealt.drop("length").write.partitionBy("block").parquet(dealt_path)
        dealt = vectors.sparkSession.read.schema("vec_id long, embedding array<double>, block long").parquet(dealt_path)
        for b in range(blocks):
            block = dealt.where(F.col("block") == b).drop("block").toArrow()
            _search_block(rows, block, length, float(np.sqrt(norm or 0.0)), config, path)
    schema = "query_id long, rank int, vec_id long, score long"
    empty = vectors.sparkSession.createDataFrame([], schema)
    empty.write.mode("append").parquet(path)  # so that there is a folder
    return vectors.sparkSession.read.schema(schema).parquet(path)
