"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check.

Defined results: a null text or one without words has fingerprint zero and is
linked like any other; fewer words than a shingle has make one shingle of all
of them. Whole texts count, however long; an empty table gives an empty result. Rows with equal ids, or without one, are separate documents for
``drop_near_duplicates``; a component without any id has a null id. Extra
columns are ignored by ``components_of`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.groups import dealt
from strandline.llm.storage import written

BITS = 64
SEED = 42
#: For each value of a byte, which of its bits are set, lowest first.
_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_START = np.arange(8, dtype=np.int64) * 256


@dataclass(frozen=True)
class SimHashConfig:
    shingle_words: int = 3
    most_bits: int = 3
    #: More blocks make rarer keys and more of them; each pair of blocks is a key.
    blocks: int = 5
    #: Fingerprints under one key that are compared in one task.
    group_rows: int = 1024

    def masks(self) -> list[int]:
        """The bits that stay when ``most_bits`` blocks are left out: close pairs agree on one mask."""
        if not self.most_bits < self.blocks <= BITS:
            raise ValueError("there must be more blocks than bits that may differ")
        edges = [BITS * i // self.blocks for i in range(self.blocks + 1)]
        block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        return [sum(c) for c in combinations(block, self.blocks - self.most_bits)]


def fingerprint_of(text: bytes | None, words: int) -> int:
    """The fingerprint of UTF-8 text: ASCII is lower-cased, words end at ASCII white space."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.array([digest(whole[a:b], SEED) for a, b in spans], dtype="<u8")
    values = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_START
    counts = np.bincount(values.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, config: SimHashConfig = SimHashConfig()) -> Column:
    """The fingerprint of each text, as a signed long with the same bits."""
    words = config.shingle_words

    def udf(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t, words) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return F.arrow_udf(udf, "long")(text.cast("binary"))


def _forest(values: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that join all values within ``most_bits`` of each other, directly or by steps; fewer than values."""
    label = np.arange(len(values))
    links = []
    for i in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= most_bits)
        if len(near):
            parts, first = np.unique(label[near], return_index=True)
            links.extend((i, int(near[f])) for f in first)
            label[: i + 1][np.isin(label[: i + 1], parts)] = label[i]
    return links


def _links_of_groups(most_bits: int):
    """Over rows sorted by group: links between close fingerprints of a group. Holds one group, which is bounded."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), dtype=np.int64)

        def links(rows: np.ndarray) -> np.ndarray:
            cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
            fp = np.ascontiguousarray(rows[:, 1]).view(np.uint64)
            pair = starts[ends - starts == 2]
            near = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= most_bits]
            out = [np.stack([fp[near], fp[near + 1]], axis=1)]
            for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                found = _forest(fp[a:b], most_bits)
                if found:
                    out.append(fp[a:b][np.array(found)])
            return np.concatenate(out)

        def made(found: np.ndarray) -> pa.RecordBatch:
            found = np.ascontiguousarray(found)
            return pa.RecordBatch.from_arrays([pa.array(found[:, i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            kept = np.concatenate([kept, rows])
            if len(kept) and kept[0, 0] != kept[-1, 0]:
                cut = int(np.flatnonzero(kept[:, 0] != kept[-1, 0])[-1]) + 1
                yield made(links(kept[:cut]))
                kept = kept[cut:]
        if len(kept):
            yield made(links(kept))

    return compare


def close_links(fingerprints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) at most ``most_bits`` apart.

    Every close pair is joined by the links, directly or by steps. A key that
    many fingerprints share is dealt out as pairs of its parts, each of at most
    about ``group_rows`` fingerprints, so no task holds a whole key.
    """
    masks = config.masks()
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    keyed = fingerprints.select("fp", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    keyed = keyed.join(shared, "key")
    ordered = dealt(keyed, "fp", config.group_rows).repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(_links_of_groups(config.most_bits), "a long, b long").distinct()


def components_of(fingerprints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``fp, least`` from ``fp, least``: the least of all values that close fingerprints reach.

    ``fingerprints`` has one row for each distinct ``fp``; copies of a document
    never meet here.
    """
    parts = connected_components(close_links(fingerprints.select("fp"), config))
    parts = parts.withColumnsRenamed({"node": "fp"})
    joined = fingerprints.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", F.xxhash64("fp")).alias("component"))
    joined = written(joined)
    least = joined.groupBy("component").agg(F.min("least").alias("reached"))
    return joined.join(least, "component").select("fp", F.col("reached").alias("least"))


def near_duplicate_components(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    marked = written(docs.select("doc_id", fingerprint(F.col("text"), config).alias("fp")))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components_of(distinct, config).withColumnRenamed("least", "component_id")
    return marked.join(reached, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """One row of each component of near-duplicates, the one with the least id; columns as they are."""
    marked = docs.select(F.struct("*").alias("doc"), "doc_id", fingerprint(F.col("text"), config).alias("fp"))
    marked = written(marked.withColumn("row", F.monotonically_increasing_id()))
    # A null id sorts last; the row number settles equal ids.
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    distinct = written(marked.groupBy("fp").agg(F.min(rank).alias("least")))
    reached = components_of(distinct, config)
    kept = reached.select(F.col("least.row").alias("row")).distinct()
    return marked.join(kept, "row", "left_semi").select("doc.*")
