"""Toxicity by the nearest labelled examples under TF-IDF cosine.

The examples are a bounded sample of the labelled rows. Terms are all words
that two examples have; their document frequencies are counted over all
documents. A term's weight is its TF-IDF times its relevance frequency (how
much more common it is among examples of label 1), so that a like tone counts
for more than a like topic; no term is left out for it. The search is exact:
postings of rare terms are added up, and frequent terms, which have most
postings, are looked up only in blocks of examples where the largest weights
of the block don't rule it out. Votes weighted by similarity are calibrated on
the examples themselves, each judged by the others.

Defined results: a null or empty text has no terms, like any text that shares
none with the vocabulary; it gets the calibrated score of such texts. Without
any labelled row, or with labels of one kind only, every score is the share of
label 1 (0 without labels). Ties in similarity go to the smaller example id.
Several labels of a document count as their largest; null labels don't count.
An id on several rows makes one example, of its largest text. Repeated rows are
scored alike and all kept. Whole texts count, however long. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import written

WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 50_000


@dataclass(frozen=True)
class ToxicityConfig:
    #: Examples of each label at most, about, picked by a hash of their id.
    examples_per_label: int = 3_000
    #: Terms of fewer examples can't join any two.
    least_examples: int = 2
    #: The power of the relevance frequency in a term's weight; 0 is plain TF-IDF.
    tone: float = 2.0
    neighbours: int = 15
    #: Similarity that an undecided vote starts with.
    doubt: float = 0.5
    block_rows: int = 128
    #: Terms in more than this share of the examples are frequent ones.
    frequent: float = 0.125
    threshold: float = 0.7


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def _sample(labelled: DataFrame, config: ToxicityConfig) -> tuple[DataFrame, dict[int, int]]:
    """About ``examples_per_label`` rows of each label, and how many there are of each."""
    there = {int(r["toxic"]): r["count"] for r in labelled.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    scale = 1 << 30
    limit = F.lit(0)
    for label, count in there.items():
        limit = F.when(F.col("toxic") == label, min(scale, int(config.examples_per_label / count * scale))).otherwise(limit)
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("tox")), F.lit(scale)) < limit), there


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``toxic, term, n`` of each example's words, counted for each batch."""
    for batch in batches:
        ones, every = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = words_of(text).keys()
            every.update(words)
            if toxic:
                ones.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array([ones[w] for w in every], pa.int64()), pa.array(every.values(), pa.int64())], ["term", "ones", "n"])


def term_counts(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``doc_id, at, n``: the places of each text's terms in the vocabulary, ascending, and how often each is there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            at: list[int] = []
            n: list[int] = []
            sizes = [0]
            for text in batch.column("text").to_pylist():
                found = sorted((i, c) for w, c in words_of(text).items() if (i := get(w)) is not None)
                at += [i for i, _ in found]
                n += [c for _, c in found]
                sizes.append(len(at))
            sizes = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(sizes, pa.array(x, pa.int32())) for x in (at, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "at", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, at array<int>, n array<int>")


def _frequencies(terms: int):
    """How many documents of a task have each term; one row for each term there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column("at").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(n[there])], ["at", "n"])

    return count


def unit_weights(at: np.ndarray, n: np.ndarray, of_term: np.ndarray) -> np.ndarray:
    """The weights of a text's terms, of unit length together."""
    w = (1.0 + np.log(n)) * of_term[at]
    size = np.sqrt((w * w).sum())
    return w / size if size > 0 else w


class BlockMaxIndex:
    """An inverted index of examples in blocks, with the largest weight of each frequent term in each block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], of_term: np.ndarray, config: ToxicityConfig = ToxicityConfig()):
        weighted = [(a, unit_weights(a, n, of_term)) for a, n in vectors]
        # Examples with the same strongest terms lie together, so blocks have low bounds elsewhere.
        order = sorted(range(len(ids)), key=lambda i: (tuple(weighted[i][0][np.argsort(-weighted[i][1], kind="stable")][:3].tolist()), ids[i]))
        self.ids, self.labels, self.of_term, self.rows = ids[order], labels[order], of_term, config.block_rows
        self.blocks = max(1, -(-len(order) // self.rows))
        example = np.concatenate([np.full(len(weighted[i][0]), k) for k, i in enumerate(order)] or [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([weighted[i][0] for i in order] or [np.zeros(0)]).astype(np.int32)
        weight = np.concatenate([weighted[i][1] for i in order] or [np.zeros(0)])
        many = np.bincount(term, minlength=len(of_term)) > config.frequent * len(order)
        #: Place of a frequent term in ``dense``, else -1.
        self.place = np.where(many, np.cumsum(many) - 1, -1)
        often = many[term]
        dense = np.zeros((int(many.sum()), self.blocks * self.rows))
        dense[self.place[term[often]], example[often]] = weight[often]
        self.dense = np.ascontiguousarray(dense.reshape(len(dense), self.blocks, self.rows).transpose(1, 0, 2))
        self.most = np.ascontiguousarray(self.dense.max(axis=2, initial=0.0).T)
        example, term, weight = example[~often], term[~often], weight[~often]
        by_term = np.argsort(term, kind="stable")
        #: Example and weight, by term.
        self.postings = np.stack([example[by_term].astype(np.float64), weight[by_term]], axis=1)
        self.start = np.searchsorted(term[by_term], np.arange(len(of_term) + 1))

    def nearest(self, at: np.ndarray, n: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows and cosines of the ``k`` nearest examples of positive similarity, nearest first; never row ``but``."""
        query = unit_weights(at, n, self.of_term)
        place = self.place[at]
        rare = place < 0
        first, end = self.start[at[rare]], self.start[at[rare] + 1]
        found = np.concatenate([self.postings[:0], *[self.postings[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]])
        products = np.repeat(query[rare], end - first) * found[:, 1]
        known = np.bincount(found[:, 0].astype(np.int64), products, self.blocks * self.rows)
        known = known.astype(np.float64, copy=False).reshape(self.blocks, self.rows)  # whole numbers if there was nothing
        often = np.zeros(len(self.most))
        often[place[~rare]] = query[~rare]
        largest = known.max(axis=1)
        bound = largest + often @ self.most
        if but is not None:
            known[but // self.rows, but % self.rows] = -np.inf
        # The best of k different blocks are k examples, so the k-th best of all is no lower.
        least = float(np.partition(largest, -k - 1)[-k - 1]) if self.blocks > k else 0.0
        order = np.argsort(-bound, kind="stable")
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        for some in (order[:4], order[4:]):
            # A block that ties with the least may still win by an id.
            some = some[(bound[some] > 0) & (bound[some] >= least - 1e-9)]
            found = known[some]
            for i, b in enumerate(some.tolist()):
                found[i] += often @ self.dense[b]
            i, j = ((found > 0) & (found >= least - 1e-9)).nonzero()
            rows, scores = np.concatenate([rows, some[i] * self.rows + j]), np.concatenate([scores, found[i, j]])
            if len(scores) > k:
                least = max(least, float(np.partition(scores, -k)[-k]))
        good = scores >= least - 1e-9
        return self._best(rows[good], scores[good], k)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[rows], -np.round(scores, 9)))[:k]
        return rows[best], scores[best]


@dataclass
class ToxicityModel:
    index: BlockMaxIndex | None
    #: How many documents an example of each label stands for.
    stands_for: np.ndarray
    #: The calibration: raw votes, and the chance of label 1 there.
    raw: np.ndarray
    chance: np.ndarray
    config: ToxicityConfig

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        label = self.index.labels[rows]
        votes = cosines * self.stands_for[label] / self.stands_for.max()
        return float(votes[label == 1].sum() / (votes.sum() + self.config.doubt * self.stands_for[1] / self.stands_for.max()))

    def score(self, at: np.ndarray, n: np.ndarray) -> tuple[float, list[int], list[float], list[int]]:
        """The calibrated score, and the neighbours' ids, cosines and labels as evidence."""
        if self.index is None:
            return float(self.chance[0]), [], [], []
        rows, cosines = self.index.nearest(at, n.astype(np.float64), self.config.neighbours)
        score = float(np.interp(self.vote(rows, cosines), self.raw, self.chance))
        return score, self.index.ids[rows].tolist(), np.round(cosines, 6).tolist(), self.index.labels[rows].tolist()


def calibration(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through votes and labels: neighbours out of order are pooled (isotonic regression)."""
    values = np.unique(raw)
    at = np.searchsorted(values, raw)
    total = np.bincount(at, weight, len(values))
    ones = np.bincount(at, weight * label, len(values))
    pools: list[list[float]] = []  # weight, weight of label 1, weighted sum of votes
    for v, t, o in zip(values, total, ones, strict=True):
        pools.append([t, o, v * t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            t2, o2, s2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + o2, pools[-1][2] + s2]
    table = np.array(pools)
    share = ones.sum() / total.sum()
    one_row = float(np.median(weight))
    return table[:, 2] / table[:, 0], (table[:, 1] + one_row * share) / (table[:, 0] + one_row)


def relevance(ones: np.ndarray, n: np.ndarray, ones_there: int, there: int) -> np.ndarray:
    """The relevance frequency of terms: how much more common each is among examples of label 1, in bits, 1 at least."""
    zeros_there = there - ones_there
    return np.log2(2 + (ones / ones_there) / (np.maximum(n - ones, 1) / zeros_there))


def fit(docs: DataFrame, labelled: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> tuple[ToxicityModel, DataFrame]:
    """A model from ``docs`` (``doc_id, text``) and ``labelled`` (``doc_id, toxic``), and the term counts of all ``docs``.

    The driver gets the examples' term counts and one frequency for each of
    their terms: bounded by the number of examples, whatever the corpus.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    labelled = labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample, there = _sample(labelled, config)
    sample = written(sample)  # bounded: about twice examples_per_label
    examples = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    examples = written(examples)
    have = np.zeros(2, dtype=np.int64)
    for r in examples.groupBy("toxic").count().collect():
        have[r["toxic"]] = r["count"]
    share = there.get(1, 0) / max(1, sum(there.values()))
    terms = examples.select("text", "toxic").mapInArrow(_example_terms, "term string, ones long, n long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    table = terms.where(F.col("n") >= config.least_examples).toPandas().sort_values("term", kind="stable") if have.all() else None
    vocabulary = spark.sparkContext.broadcast({} if table is None else {t: i for i, t in enumerate(table["term"].tolist())})
    counted = written(term_counts(docs, vocabulary))
    # Term counts are small files but as much work to search for as their texts are many: as many parts as those have.
    counted = counted.repartition(max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    if table is None or not len(table):
        return ToxicityModel(None, np.ones(2), np.zeros(1), np.full(1, share), config), counted
    frequency, documents = np.zeros(len(table)), counted.count()
    for r in counted.select("at").mapInArrow(_frequencies(len(table)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r["at"]] = r["n"]
    idf = np.log((1 + documents) / (1 + frequency)) + 1e-3
    tone = relevance(table["ones"].to_numpy(), table["n"].to_numpy(), int(have[1]), int(have.sum()))
    mine = term_counts(examples, vocabulary).join(F.broadcast(sample), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    vectors = [(np.asarray(a, np.int64), np.asarray(n, np.float64)) for a, n in zip(mine["at"], mine["n"], strict=True)]
    index = BlockMaxIndex(mine["doc_id"].to_numpy(), mine["toxic"].to_numpy(), vectors, idf * tone**config.tone, config)
    stands_for = np.array([there.get(0, 0), there.get(1, 0)]) / np.maximum(1, have)
    model = ToxicityModel(index, stands_for, np.zeros(1), np.zeros(1), config)
    raw = _leave_one_out(model, term_counts(examples, vocabulary))
    model.raw, model.chance = calibration(raw, index.labels, stands_for[index.labels])
    return model, counted


def _leave_one_out(model: ToxicityModel, counted: DataFrame) -> np.ndarray:
    """The vote on each example, by row of the index, when it is left out."""
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        by_id = np.argsort(own.index.ids, kind="stable")
        for batch in batches:
            rows = by_id[np.searchsorted(own.index.ids[by_id], batch.column("doc_id").to_numpy(zero_copy_only=False))]
            votes = []
            for row, at, n in zip(rows.tolist(), batch.column("at"), batch.column("n"), strict=True):
                at, n = at.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False).astype(np.float64)
                votes.append(own.vote(*own.index.nearest(at, n, own.config.neighbours, but=row)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(votes, pa.float64())], ["row", "vote"])

    raw = np.zeros(len(model.index.ids))
    dealt = counted.repartition(spark.sparkContext.defaultParallelism)
    for r in dealt.mapInArrow(judge, "row long, vote double").collect():  # a number for each example
        raw[r["row"]] = r["vote"]
    shared.destroy()
    return raw


RESULT = "doc_id long, score double, neighbour_ids array<long>, cosines array<double>, neighbour_labels array<int>"


def score(model: ToxicityModel, counted: DataFrame) -> DataFrame:
    """``doc_id``, the score and its evidence, for each row of term counts."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            found = []
            for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
                at, n = at.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
                key = xxhash.xxh3_128_intdigest(at.tobytes() + n.tobytes())
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = shared.value.score(at, n)
                found.append(known[key])
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            types = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "score", "neighbour_ids", "cosines", "neighbour_labels"])

    return counted.mapInArrow(search, RESULT)
