"""Comparing what shares a key: a crowded key is dealt out as pairs of its parts, and sets meet those of like sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(keyed: DataFrame, node: str, group_rows: int) -> DataFrame:
    """``group`` and ``node`` for each row of ``keyed`` (``key``, its ``count``, and a column ``node``).

    All nodes of a key with at most ``group_rows`` of them are one group. Those
    of a larger key are dealt to parts, and each two parts are a group: any two
    nodes meet, and no group has more than about ``group_rows``.
    """
    half = group_rows // 2
    few = F.col("count") <= group_rows
    parts = F.ceil(F.col("count") / half).cast("int")
    part: Column = F.when(few, 0).otherwise(F.pmod(F.xxhash64(node, F.lit(7)), parts)).cast("int")
    other = F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))
    pairs = keyed.select("key", node, part.alias("part"), F.explode(other).alias("other"))
    return pairs.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("group"), node)


def dealt_across(labelled: DataFrame, node: str, group_rows: int) -> DataFrame:
    """``group``, ``node`` and ``component`` for rows of ``key``, ``node`` and ``component``, so that nodes of different components under one key meet.

    Keys of one component need nothing. Nodes of a crowded key's largest
    component don't meet each other, so what is made grows with the pairs that
    are still to be compared, not with the square of the key's nodes.
    """
    half = group_rows // 2
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("count")).where("count > top.n")
    sides = [F.ceil(n / half).cast("int") for n in (F.col("top.n"), F.col("count") - F.col("top.n"))]
    few = F.col("count") <= group_rows
    keys = keys.select("key", F.col("top.component").alias("most"), few.alias("few"), *[F.when(few, 1).otherwise(n).alias(c) for n, c in zip(sides, ("large", "small"), strict=True)])
    own = labelled.join(keys, "key").withColumn("in_most", F.col("component") == F.col("most"))
    own = own.withColumn("part", F.pmod(F.xxhash64(node, F.lit(7)), F.when(F.col("in_most"), F.col("large")).otherwise(F.col("small"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.when(F.col("in_most"), F.transform(every("small"), lambda r: F.xxhash64("key", F.lit(0), "part", r)))
    across = across.otherwise(F.transform(every("large"), lambda q: F.xxhash64("key", F.lit(0), q, "part")))
    rest = F.transform(F.filter(every("small"), lambda r: r != F.col("part")), lambda r: F.xxhash64("key", F.lit(1), F.least("part", r), F.greatest("part", r)))
    groups = F.when(F.col("in_most"), across).otherwise(F.concat(across, rest))
    return own.select(F.explode(groups).alias("group"), node, "component")


def keys_to_compare(labelled: DataFrame, node: str) -> DataFrame:
    """``key, count`` of keys with several components, of rows ``key``, ``component`` and ``node``; of keys with the same nodes, one.

    Texts that have one passage in common share many keys and need to meet
    once. Keys have the same nodes if two 64-bit digests of all nodes and their
    number are equal.
    """
    digests = [F.bit_xor(F.xxhash64(node, F.lit(i))).alias(f"digest{i}") for i in (0, 1)]
    keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("count"), *digests)
    return keys.where("low <> high").groupBy("count", "digest0", "digest1").agg(F.min("key").alias("key")).select("key", "count")


def forest(nodes: Sequence[int], sets: Sequence[np.ndarray], similarity: float, parts: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Links that join all pairs of sets of that Jaccard similarity or more, directly or by steps; fewer than sets.

    Sets of equal ``parts`` are joined already. Empty sets have no links.
    """
    by_size = sorted((i for i, own in enumerate(sets) if len(own)), key=lambda i: len(sets[i]))
    label = np.unique([parts[i] for i in by_size], return_inverse=True)[1] if len(parts) else np.arange(len(by_size))
    if len(by_size) < 2 or (label == label[0]).all():
        return []
    sizes = np.array([len(sets[i]) for i in by_size])
    numbers = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)[1]
    ranks = np.split(numbers, np.cumsum(sizes)[:-1])
    own = np.zeros(numbers.max() + 1, bool)
    links = []
    for i in range(1, len(by_size)):
        # Similar sets have similar sizes; what is joined already needs no look.
        low = int(np.searchsorted(sizes, similarity * sizes[i] - 1e-9))
        others = low + np.flatnonzero(label[low:i] != label[i])
        if not len(others):
            continue
        own[ranks[i]] = True
        ends = np.cumsum(sizes[others])
        both = np.add.reduceat(own[np.concatenate([ranks[j] for j in others])], ends - sizes[others], dtype=np.int64)
        own[ranks[i]] = False
        for j in others[both >= similarity * (sizes[others] + sizes[i] - both) - 1e-9]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((nodes[by_size[i]], nodes[by_size[j]]))
    return links


def links_of_groups(similarity: float, members: Callable[[pa.Scalar], np.ndarray]):
    """Over rows ``group, content, shingles`` and perhaps ``component``, sorted by group: links ``a, b`` within each. Holds one group.

    ``members`` makes an array of what is in column ``shingles``. What has one
    ``component`` is joined already.
    """

    def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, contents, sets, parts = None, [], [], []
        for batch in batches:
            links = []
            known = batch.column("component").to_pylist() if "component" in batch.schema.names else None
            for at, (g, c, s) in enumerate(zip(batch.column("group").to_pylist(), batch.column("content").to_pylist(), batch.column("shingles"), strict=True)):
                if g != group:
                    links += forest(contents, sets, similarity, parts)
                    group, contents, sets, parts = g, [], [], []
                contents.append(c)
                sets.append(members(s))
                if known:
                    parts.append(known[at])
            yield made(links)
        yield made(forest(contents, sets, similarity, parts))

    return compare
