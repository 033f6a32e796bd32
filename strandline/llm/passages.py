"""Passages that documents share: paragraph MinHash banding with exact verification.

A text is cut into short paragraphs at places that its own words decide, so a
passage is cut alike wherever it stands. Each place has a number, a hash of the
words there, and places after a sentence end have lower ones than all others; a
cut is where a number is the lowest for some words on both sides. The text's
start and end are borders too, so a text without a cut is one paragraph. Equal
paragraphs are found by a hash of their words, similar ones by bands of MinHash
values; paragraphs that collide are verified by exact Jaccard similarity of
their word shingles and clustered by connected components. Neighbouring
repeated paragraphs of a document make a passage, if they are long enough or
the whole text.

Defined results: null texts and texts under ``paragraph_words`` words have no
paragraphs. Rows with equal id and equal text are one document, so a repeated
row repeats nothing. Words end at white space; case counts. A passage that only
one document has, however often, is left alone. Of each cluster the document
with the least id keeps its copy; a null id comes last. Extra columns are
ignored by ``shared_passages`` and kept by ``remove_passages``. Whole texts
count; a task holds about 100 bytes for each word of the longest. An empty
table gives an empty result. Equal paragraphs, and rows, are told by 64-bit
hashes: among 10^10 different paragraphs about three pairs are taken as equal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.groups import dealt, links_of_groups
from strandline.llm.storage import discard, release, written


#: Words, and the white space between them.
PIECE = re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class PassageConfig:
    shingle_words: int = 5
    similarity: float = 0.8
    #: How likely a pair of paragraphs at the similarity must be to collide; the bands follow from it. A passage has
    #: several paragraphs, so it is missed much more seldom.
    recall: float = 0.99
    band_rows: int = 1
    #: Paragraphs have this many words at least; passages of repeated paragraphs that many, or all words of their text.
    #: Shared runs of fewer words are mostly stock phrases.
    paragraph_words: int = 7
    passage_words: int = 24
    #: Repeated paragraphs at most so many words apart are one passage.
    gap_words: int = 8
    #: Paragraphs with fewer different shingles are mere repetition.
    least_shingles: int = 3
    #: Paragraphs under one key that are compared in one task.
    group_rows: int = 512
    #: Bytes of text that are cut at once, or else one text.
    at_once: int = 1 << 19

    def bands(self) -> int:
        """As few bands as give the recall: one misses with ``1 - similarity ** band_rows``."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**self.band_rows))


def _mixed(values: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash function over 64-bit hashes: an odd multiple, then its high bits folded down."""
    multiple = np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1))
    product = values * multiple
    return product ^ (product >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """A hash of each word; its lowest bit says whether a sentence ends there."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) & ~1 | (word[-1] in b".!?")
        if len(word) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


REMEMBERED = 300_000
_HASHES = _WordHashes()


@dataclass
class Paragraphs:
    """Paragraphs of some texts: which text, where they begin and end among the words of all, a hash of the words; and all shingles."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    content: np.ndarray
    shingles: np.ndarray
    #: Words before each text, and up to its end.
    before: np.ndarray
    after: np.ndarray

    def shingles_of(self, i: int, words: int) -> np.ndarray:
        return self.shingles[self.start[i] : self.end[i] - words + 1]


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from each place where there are so many."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    more = width - done
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


LAST = np.uint64((1 << 64) - 1)


def cut(texts: list[bytes | None], config: PassageConfig) -> Paragraphs:
    """The paragraphs of UTF-8 texts."""
    words, sizes, k, least = [], [], config.shingle_words, max(config.shingle_words, config.paragraph_words)
    for text in texts:
        parts = (text or b"").split()
        words += parts
        sizes.append(len(parts))
    sizes = np.array(sizes, dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    n = len(words)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    # Shingles that reach into the next text are made too, and never used.
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, n)):
        shingles[: n - i] += _mixed(hashes[i:], 31 + i)
    shingles = _mixed(shingles, 29)
    number = shingles >> np.uint64(1)
    number[1:] |= (~hashes[:-1] & np.uint64(1)) << np.uint64(63)  # not after a sentence end
    long = np.flatnonzero(sizes >= least)
    # No cut stands so near to a text's end that the rest is no paragraph; at its start there always is one.
    ends = before + sizes
    tail = (ends[:, None] - np.arange(least)[None, 1:]).ravel()
    number[tail[tail >= np.repeat(before, least - 1)]] = LAST
    number[before[long]] = 0
    border = np.full(least - 1, LAST)
    around = _least_of(np.concatenate([border, number, border]), least - 1)
    chosen = (number < around[:n]) & (number <= around[least : least + n]) & (number < LAST)
    chosen[before[long]] = True
    start = np.flatnonzero(chosen)
    text = np.searchsorted(before, start, side="right") - 1
    end = np.minimum(np.append(start[1:], n), ends[text])
    # Overlapping shingles fix the order of the words, so their sum stands for the paragraph.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(shingles, 5), dtype=np.uint64)])
    content = _mixed(sums[end - k + 1] - sums[start] + (end - start).astype(np.uint64), 7)
    return Paragraphs(text, start, end, content, shingles, before, ends)


def band_values(found: Paragraphs, config: PassageConfig) -> list[np.ndarray]:
    """For each band a value of each paragraph: its MinHash values, hashed together with the band's number."""
    if not len(found.start):
        return [np.zeros(0, np.uint64)] * config.bands()
    # reduceat takes pairs of begin and end; every other result is of what lies between.
    edges = np.stack([found.start, found.end - config.shingle_words + 1], axis=1).ravel()
    out = []
    for band in range(config.bands()):
        value = np.full(len(found.start), np.uint64(band + 1))
        for row in range(config.band_rows):
            hashes = np.append(_mixed(found.shingles, band * config.band_rows + row), LAST)
            value = _mixed(value ^ np.minimum.reduceat(hashes, edges)[::2], 17 + row)
        out.append(value)
    return out


def _portions(texts: list[bytes | None], at_once: int) -> Iterator[tuple[int, int]]:
    """Neighbours of so many bytes together at most, or single texts."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text or b"") > at_once:
            yield first, i
            first, held = i, 0
        held += len(text or b"")
    yield first, len(texts)


def _paragraph_rows(config: PassageConfig):
    """``content, row, start, end``, the text's words and a column for each band, of each paragraph that isn't mere repetition."""
    names = ["content", "row", "start", "end", "words", *_band_names(config)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column("row").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in _portions(texts, config.at_once):
                found = cut(texts[a:b], config)
                keep = _varied(found, config)
                text = found.text[keep]
                first = found.before[text]
                places = [(x - first).astype(np.int32) for x in (found.start[keep], found.end[keep], found.after[text])]
                bands = [x[keep].view(np.int64) for x in band_values(found, config)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found.content[keep].view(np.int64), row[a:b][text], *places, *bands)], names)

    return rows


def _band_names(config: PassageConfig) -> list[str]:
    return [f"band{i}" for i in range(config.bands())]


def _varied(found: Paragraphs, config: PassageConfig) -> np.ndarray:
    """Which paragraphs have enough different shingles; repetition shows as shingles equal to a near one before."""
    s = found.shingles
    new = np.ones(len(s), dtype=bool)
    for back in range(1, 7):
        new[back:] &= s[back:] != s[:-back]
    total = np.concatenate([[0], np.cumsum(new)])
    return total[found.end - config.shingle_words + 1] - total[found.start] >= config.least_shingles


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id"), F.col("text").cast("binary").alias("text"))


def _shingle_sets(config: PassageConfig):
    """``content, shingles`` of the wanted paragraphs of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("wanted")
            for a, b in _portions(texts, config.at_once):
                found = cut(texts[a:b], config)
                wanted = np.unique(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
                content = found.content.view(np.int64)
                contents, first = np.unique(content, return_index=True)
                first = first[np.isin(contents, wanted)]
                sets = [np.unique(found.shingles_of(i, config.shingle_words)).view(np.int64) for i in first.tolist()]
                sizes = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(content[first]), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["content", "shingles"])

    return rows


def _colliding(contents: DataFrame, config: PassageConfig) -> DataFrame:
    """``key, content, count``: contents of keys that several documents have, and how many contents a key has.

    Keys of different bands never are the same, so each band is done by itself
    and its shuffles are dropped before the next.
    """
    parts = []
    for band in _band_names(config):
        keyed = contents.select("content", "low", "high", F.col(band).alias("key"))
        # A key of one content, or within one document, is nothing shared.
        spread = keyed.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("count"))
        spread = spread.where("least <> most AND count > 1").select("key", "count")
        # Only what collides is followed further.
        parts.append(written(keyed.select("key", "content").join(spread, "key")))
        release(contents)
    colliding = written(reduce(DataFrame.union, parts))
    discard(*parts)
    return colliding


def similar_links(docs: DataFrame, contents: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """Links ``a, b`` between different contents whose shingle sets are similar.

    ``contents`` has ``content, low, high`` (the least and largest document with
    it) and the bands.
    """
    colliding = _colliding(contents, config)
    # A content has one document that it is read from again, whose text is taken once.
    wanted = contents.select(F.col("low").alias("row"), "content").join(colliding.select("content").distinct(), "content", "left_semi").groupBy("row").agg(F.collect_list("content").alias("wanted"))
    # Joined first, so that of repeated rows only wanted ones are sorted again.
    texts = _numbered(docs).select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("text", "wanted")
    sets = texts.mapInArrow(_shingle_sets(config), "content long, shingles array<long>").dropDuplicates(["content"])
    grouped = dealt(colliding, "content", config.group_rows).join(sets, "content").select("group", "content", "shingles")
    ordered = grouped.repartition("group").sortWithinPartitions("group")
    links = written(ordered.mapInArrow(links_of_groups(config.similarity, lambda x: x.values.to_numpy()), "a long, b long"))
    discard(colliding)
    return links.distinct()


def repeated_paragraphs(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``row, start, end, words, component``: paragraphs whose like another document has, and how many words its text has."""
    columns = ", ".join(f"{b} long" for b in _band_names(config))
    made = f"content long, row long, start int, end int, words int, {columns}"
    paragraphs = written(_numbered(docs).select("row", "text").mapInArrow(_paragraph_rows(config), made))
    bands = [F.min(b).alias(b) for b in _band_names(config)]  # equal for equal contents
    contents = written(paragraphs.groupBy("content").agg(F.min("row").alias("low"), F.max("row").alias("high"), *bands))
    release(contents)
    parts = connected_components(similar_links(docs, contents, config)).withColumnRenamed("node", "content")
    # What is alone has no part in a component and stands in one document only.
    linked = contents.select("content", "low", "high").join(parts, "content", "left").where("component IS NOT NULL OR low <> high")
    linked = written(linked.select("content", "low", "high", F.coalesce("component", F.xxhash64("content")).alias("component")))
    discard(contents)
    spread = linked.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    repeated = linked.join(spread.select("component"), "component", "left_semi").select("content", "component")
    at = paragraphs.select("content", "row", "start", "end", "words")
    found = written(at.join(repeated, "content").select("row", "start", "end", "words", "component"))
    discard(paragraphs, linked)
    return found


def shared_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``row, doc_id, start_word, end_word, removed, components`` for each passage that documents share.

    ``removed`` is false in the documents that keep a cluster's copy. Passages
    end before ``end_word``.
    """
    ids = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id").distinct()
    found = repeated_paragraphs(docs, config)
    found = written(found.distinct().join(ids, "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keeper = found.groupBy("component").agg(first["row"].alias("keeper"))
    marked = found.join(keeper, "component").withColumn("removed", F.col("row") != F.col("keeper"))
    order = Window.partitionBy("row", "removed").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start") > before + config.gap_words), 1).otherwise(0)
    run = F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("begins", begins).withColumn("run", run).groupBy("row", "doc_id", "words", "removed", "run")
    passages = runs.agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.sort_array(F.collect_set("component")).alias("components"))
    length = F.col("end_word") - F.col("start_word")
    long = (length >= config.passage_words) | (length == F.col("words"))
    return passages.where(long).select("row", "doc_id", "start_word", "end_word", "removed", "components")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between words stays."""
    out, at, word = [], 0, 0
    edges = sorted(spans)
    for piece in _pieces(text):
        if piece[:1].isspace():
            out.append(piece)
            continue
        while at < len(edges) and edges[at][1] <= word:
            at += 1
        if not (at < len(edges) and edges[at][0] <= word):
            out.append(piece)
        word += 1
    return "".join(out)


def _pieces(text: str) -> list[str]:
    return PIECE.findall(text)


def remove_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``docs`` without the copies of shared passages; columns as they are."""
    spans = shared_passages(docs, config).where("removed").groupBy("row").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))

    def udf(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if not s else without_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in pairs], pa.string())

    doc: Column = F.struct(*docs.columns)
    joined = docs.select(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("row")).join(spans, "row", "left")
    text = F.arrow_udf(udf, "string")(F.col("doc.text"), F.col("spans"))
    return joined.withColumn("new_text", text).select(*[F.col("new_text").alias("text") if c == "text" else F.col(f"doc.{c}") for c in docs.columns])
