"""Language identification by words, with backoff to character n-grams.

A known word scores by its log frequency in each language; another one by the
mean over its longest known n-grams. The vocabulary is all of a bounded sample
of labelled rows; none of its words or n-grams is left out. They are kept as
sorted 64-bit hashes beside a table of scores.

Defined results: a null text or one without a letter gives language ``und``,
score 0 and depth 0; so does every text when no labelled row was there to learn
from. Equal scores go to the language that sorts first. Repeated rows are
scored alike and all kept. Whole texts are scored, in portions of bounded size
or one text at a time. An empty table gives an empty result. Other columns of
the input are passed through untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.storage import discard, written

UNKNOWN = "und"
#: A run of letters; digits and underscores are no letters.
WORD = re.compile(r"[^\W\d_]+")
#: Words, and letters of them, that one Python worker remembers before it starts afresh.
REMEMBERED, LETTERS = 200_000, 4_000_000
#: Letters of text that are scored at once, or else one text.
AT_ONCE = 500_000


@dataclass(frozen=True)
class LangIdConfig:
    #: The classifier is fitted on at most this many labelled rows, picked by a hash of their id and text.
    sample_rows: int = 8_000
    longest_gram: int = 5
    smoothing: float = 0.5


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_keys(words: Sequence[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def gram_keys(words: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word each n-gram is of, and its hash. Words have a mark at both ends."""
    codes = np.frombuffer("".join([f"_{w}_" for w in words]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    grams = np.maximum(sizes - n + 1, 0)
    word = np.repeat(np.arange(len(words)), grams)
    at = np.arange(len(word)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(grams) - grams), grams)
    key = np.full(len(at), np.uint64(n))
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[at + k]
    return word, _mixed(key)


@dataclass
class LangIdModel:
    """Log frequencies by language, of words and of n-grams, beside their sorted hashes."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray
    longest_gram: int = 5

    @classmethod
    def of(cls, languages: list[str], words: Mapping[str, Sequence[float]], grams: Mapping[str, Sequence[float]], longest_gram: int) -> LangIdModel:
        """From log frequencies; n-grams are written with "_" for a word's ends."""
        keys = [word_keys(list(words)), np.array([_one_gram(g) for g in grams], np.uint64)]
        scores = [np.array(list(x.values()), np.float32).reshape(len(x), len(languages)) for x in (words, grams)]
        orders = [np.argsort(k) for k in keys]
        (words_, word_scores), (grams_, gram_scores) = [(k[o], s[o]) for k, s, o in zip(keys, scores, orders, strict=True)]
        return cls(languages, words_, word_scores, grams_, gram_scores, longest_gram)


def _one_gram(gram: str) -> int:
    word, keys = gram_keys([gram], len(gram))
    return int(keys[1])  # of the three in "_gram_" the one without the marks


def _labelled_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the labelled rows, whatever their number; the same ones each time.

    They are picked by a hash of id and text, so an id of many rows neither
    fills the sample nor leaves it empty.
    """
    there = labelled.count()
    if there <= rows:
        return labelled
    picked = labelled.withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    share = (rows + 6 * rows**0.5) / there
    while True:
        some = written(picked.where(F.col("at") < min(1.0, share) * (1 << 30)))
        # Rows that are alike in all are picked together or not at all; where they are most of the table, more is looked at.
        if share >= 1 or some.count() >= rows / 2:
            break
        discard(some)
        share *= 8
    least = written(some.orderBy("at").limit(rows).drop("at"))
    discard(some)
    return least.repartition(labelled.sparkSession.sparkContext.defaultParallelism)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts[lang].update(WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "count"])


def _unit_counts(longest: int):
    """``lang, n, key, count`` of the words (n = 0) and their different n-grams, summed over each batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, counts = np.array(batch.column("lang").to_pylist(), object), batch.column("count").to_numpy(zero_copy_only=False)
            words = batch.column("word").to_pylist()
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                some, n_of = [words[i] for i in own], counts[own]
                for n in range(longest + 1):
                    word, key = gram_keys(some, n) if n else (np.arange(len(some)), word_keys(some))
                    # An n-gram counts once for a word, so runs of a letter don't outweigh all else.
                    order = np.lexsort((key, word))
                    word, key = word[order], key[order]
                    new = np.ones(len(key), dtype=bool)
                    new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
                    keys, at = np.unique(key[new], return_inverse=True)
                    sums = np.bincount(at, n_of[word[new]], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], ["lang", "n", "key", "count"])

    return rows


def fit(labelled: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Learn from columns ``doc_id, text, lang`` of rows whose text and lang are given.

    What comes to the driver are numbers for the words and n-grams of
    ``config.sample_rows`` texts, whatever the corpus.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sample = _labelled_sample(labelled, config.sample_rows).select("text", "lang")
    words = written(sample.mapInArrow(_word_counts, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count")))
    units = words.mapInArrow(_unit_counts(config.longest_gram), "lang string, n int, key long, count long")
    table = units.groupBy("lang", "n", "key").agg(F.sum("count").alias("count")).toArrow()
    discard(words)
    return _model(table, config)


def _model(table: pa.Table, config: LangIdConfig) -> LangIdModel:
    # By codes: a string for each row would be most of what the driver holds.
    coded = table["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    place = {x: i for i, x in enumerate(languages)}
    lang = np.array([place[x] for x in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    n, key, count = (table[c].to_numpy() for c in ("n", "key", "count"))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for size in range(config.longest_gram + 1):
        some = n == size
        keys, at = np.unique(key[some].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        counts[at, lang[some]] = count[some]
        total = counts.sum(axis=0) + config.smoothing * len(keys)
        found.append((keys, np.log((counts + config.smoothing) / np.maximum(total, 1e-9)).astype(np.float32)))
    grams = np.concatenate([k for k, _ in found[1:]])
    scores = np.concatenate([s for _, s in found[1:]])
    order = np.argsort(grams)
    return LangIdModel(languages, *found[0], grams[order], scores[order], config.longest_gram)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Scorer:
    """Scores of words: worked out once each and remembered."""

    def __init__(self, model: LangIdModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.letters = 0
        #: Scores by language, and the depth: length of the n-grams found, or one more for a known word.
        self.rows = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        model = self.model
        rows = np.zeros((len(words), len(model.languages) + 1))
        at = _find(model.words, word_keys(words))
        known = at >= 0
        rows[known, :-1], rows[known, -1] = model.word_scores[at[known]], model.longest_gram + 1
        left = np.flatnonzero(~known)
        for n in range(model.longest_gram, 0, -1):
            if not len(left):
                break
            word, keys = gram_keys([words[i] for i in left.tolist()], n)
            at = _find(model.grams, keys)
            word, at = word[at >= 0], at[at >= 0]
            have = np.bincount(word, minlength=len(left))
            some = have > 0
            for j in range(len(model.languages)):
                rows[left[some], j] = np.bincount(word, model.gram_scores[at, j], len(left))[some] / have[some]
            rows[left[some], -1] = n
            left = left[~some]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.rows = np.concatenate([self.rows, rows])
        self.letters += sum(map(len, words))

    def of(self, word: str) -> np.ndarray:
        return self.score_words([[word]])[0][:-1]

    def score_words(self, texts: list[list[str]]) -> np.ndarray:
        """Of each text the sums of its words' rows."""
        if len(self.place) > REMEMBERED or self.letters > LETTERS:
            self.forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = [w for t in texts for w in t]
        if new := [w for w in dict.fromkeys(words) if w not in self.place]:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        sums = np.zeros((len(texts), self.rows.shape[1]))
        full = sizes > 0
        if len(words):
            sums[full] = np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return sums

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text its language, how sure that is, and how deep its words are known: their mean depth."""
        out: list[tuple[str, float, float]] = []
        first, held = 0, 0
        for i, text in enumerate([*texts, None]):
            if i == len(texts) or held and held + len(text or "") > AT_ONCE:
                out += self._portion(texts[first:i])
                first, held = i, 0
            held += len(text or "")
        return out

    def _portion(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        n = np.fromiter(map(len, words), np.int64, len(words))
        sums = self.score_words(words)
        total = sums[:, :-1] / np.sqrt(np.maximum(n, 1))[:, None]  # words of a text aren't independent
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share = share[np.arange(len(best)), best] / share.sum(axis=1)
        depth = sums[:, -1] / np.maximum(n, 1)
        # The pattern takes some numerals, such as "Ⅷ" or "²", for words.
        lettered = [bool(w) and (w[0].isalpha() or any(map(str.isalpha, t))) for w, t in zip(words, texts, strict=True)]
        return [(self.model.languages[b], float(s), float(d)) if ok and k else (UNKNOWN, 0.0, 0.0) for b, s, d, ok, k in zip(best.tolist(), share, depth, lettered, n.tolist(), strict=True)]


RESULT = "struct<lang_pred: string, score: double, depth: double>"


def identify(text: Column, model: Broadcast) -> Column:
    """A struct ``lang_pred, score, depth`` for each text, under a broadcast model."""
    scorers: list[Scorer] = []

    def udf(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Scorer(model.value))
        found = scorers[0].score(texts.to_pylist())
        names, scores, depths = zip(*found, strict=True) if found else ((), (), ())
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(depths, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "depth"])

    return F.arrow_udf(udf, RESULT)(text)


def broadcast_model(spark: SparkSession, model: LangIdModel) -> Broadcast:
    """The model's size is bounded by the number of labelled rows it was fitted on."""
    return spark.sparkContext.broadcast(model)


def keep_identified(docs: DataFrame, least_share: float = 0.8, doubt: float = 5, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that labelled rows have; columns as they are.

    Texts without a letter go, and those whose words are known much less deep
    than usual: in texts of a learned language, words are known whole or by
    5-grams (depth 5 to 6); in texts of another, or of no language, mostly by
    shorter ones. No text is evidence for itself: there are two models, each of
    the labelled rows of one half of all texts, and a text is judged by that of
    the other half, copies of it included. What is usual is the median depth of
    the sampled texts labelled with a language under the other half's model; a
    text needs ``least_share`` of that of the language it is taken for, or
    n / (n + ``doubt``) of this where n sampled texts of all languages are the evidence.
    Without labelled rows in the other half nothing can be judged, and only
    texts without a letter go.
    """
    half = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2))
    labelled = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    samples = [written(_labelled_sample(labelled.where(half == i), config.sample_rows)) for i in (0, 1)]
    models = [fit(s, config) for s in samples]
    sent = [broadcast_model(docs.sparkSession, m) for m in models]
    # Median depths of both halves' samples by label: a row a language.
    depths = [s.select("lang", identify(F.col("text"), sent[1 - i]).alias("found")).groupBy("lang").agg(F.median("found.depth"), F.count("*")) for i, s in enumerate(samples)]
    usual = []
    for rows in (d.collect() for d in depths):
        n = sum(r[2] for r in rows)
        usual.append({r[0]: r[1] * n / (n + doubt) for r in rows})
    discard(*samples)

    def stays(i: int) -> Column:
        if not models[1 - i].languages:
            return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        found = identify(F.col("text"), sent[1 - i])
        least = F.lit(least_share * min(usual[i].values(), default=0.0))
        for lang, depth in usual[i].items():
            least = F.when(found["lang_pred"] == lang, F.lit(least_share * depth)).otherwise(least)
        return (found["lang_pred"] != UNKNOWN) & (found["depth"] >= least)

    # Each half is scored by one model only.
    return docs.where(half == 0).where(stays(0)).unionByName(docs.where(half == 1).where(stays(1)))
