"""Odd rows: each operator has a defined result for them and crashes on none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import langid, media, mixing, packing, passages, pii, shards, simhash, topk, toxicity
from tests.llm.conftest import ODD, PLAIN, make


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_language(spark, docs, no_docs):
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert None not in texts and "" not in texts and "12345 !!! ???" not in texts and texts.count(PLAIN) == 3
    assert langid.keep_identified(no_docs).count() == 0
    model = langid.fit(docs.where("false"))
    assert langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(texts)
    found = docs.select("doc_id", langid.identify(F.col("text"), langid.broadcast_model(spark, model)).alias("r")).collect()
    assert {(r["r"]["lang_pred"], r["r"]["score"]) for r in found} == {("und", 0.0)} and len(found) == len(ODD)


def test_simhash(spark, docs, no_docs):
    found = simhash.near_duplicate_components(docs.select("doc_id", "text"))
    rows = found.collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: (r["fp"], r["component_id"]) for r in rows if r["doc_id"]}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 1) and by_id[4] == by_id[5] and by_id[4][1] == 4
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(4) == 1 and 2 not in ids and 5 not in ids
    assert simhash.near_duplicate_components(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicate_components(make(spark, [(None, "a b c d", None, None)])).first()["component_id"] is None


def test_media(docs, no_docs):
    rows = media.audio_features(docs).collect()
    assert len(rows) == len(ODD) and media.audio_features(no_docs).count() == 0
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["n_bytes"] == 0 and media.payload_of_wav(bytes(r["media"])) == b" " * 192 for r in empty)
    long = next(r for r in rows if r["doc_id"] == 9)
    assert long["n_bytes"] == 300_000 and media.payload_of_wav(bytes(long["media"])).rstrip(b" ").decode() == "ä" * 150_000
    assert len({(r["media"], r["tensors"]) for r in rows if r["doc_id"] in (4, 5)}) == 1


def test_shards(docs, no_docs):
    rows = shards.reshard(docs, F.xxhash64("source"), shards.ShardConfig(shards=4, chunk_rows=3)).collect()
    assert len(rows) == len(ODD) and shards.reshard(no_docs, F.xxhash64("source")).count() == 0
    assert sorted((tuple(r["doc"]) for r in rows), key=str) == sorted(map(tuple, docs.collect()), key=str)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_packing(docs, no_docs):
    rows = packing.pack(docs.drop("row")).collect()
    assert packing.pack(no_docs.drop("row")).count() == 0
    assert len({r["row"] for r in rows}) == len(ODD)
    one = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["length"] == 1 and r["start"] == 0 for r in one)
    check_sequences(rows)


def check_sequences(rows, capacity=1024):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    by_row = {}
    for r in rows:
        by_row.setdefault(r["row"], []).append((r["piece"], r["start"], r["length"]))
    for parts in by_row.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and (k == 0 or length == capacity)
            at += length


def test_mixing(docs, no_docs):
    config = mixing.MixingConfig(budget=3.0)
    rows = mixing.replicate(docs, config).collect()
    assert set(mixing.mix(docs, config).columns) == set(docs.columns)
    assert mixing.mix(no_docs).count() == 0
    assert key(rows, "doc_id", "text", "copy") == key(mixing.mix(docs, config).collect(), "doc_id", "text", "copy")
    same = [r["copy"] for r in rows if r["doc_id"] == 4]
    assert same.count(0) in (0, 2)  # a repeated row is drawn alike
    assert {r["source"] for r in mixing.rates(docs).collect()} == {"a", "b", "c", None}
    only = mixing.MixingConfig(weights={"b": 1.0, "a": 0.0, "z": 5.0})
    assert {r["source"] for r in mixing.replicate(docs, only).collect()} <= {"b"}


def test_pii(docs, no_docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and pii.redact(no_docs).count() == 0
    assert key(out.collect(), "doc_id", "text", "n_chars") == key(docs.collect(), "doc_id", "text", "n_chars")
    found = docs.select(pii.detect(F.col("text")).alias("r")).collect()
    assert {r["r"]["spans"] for r in found} == {""} and len(found) == len(ODD)


def test_toxicity(spark, docs, no_docs):
    labels = spark.createDataFrame([(4, 0), (4, None), (5, 1), (6, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    for given, size in ((docs, len(ODD)), (no_docs, 0)):
        for some in (labels, labels.where("toxic = 0"), labels.where("false")):
            rows = toxicity.score(*toxicity.fit(given, some)).collect()
            assert len(rows) == size and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.score(*toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}


def test_passages(spark, docs, no_docs):
    rows = passages.shared_passages(docs).collect()
    assert {r["doc_id"] for r in rows} <= {4, 5, None} and passages.shared_passages(no_docs).count() == 0
    out = passages.remove_passages(docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    alone = make(spark, [(4, PLAIN * 3, None, None), (4, PLAIN * 3, None, None)])
    assert passages.shared_passages(alone).count() == 0


@pytest.mark.parametrize("bad", [0, 3])
def test_too_few_blocks(bad):
    with pytest.raises(ValueError, match="blocks"):
        simhash.SimHashConfig(blocks=bad).masks()


def test_topk(spark):
    schema = "vec_id long, embedding array<float>, rank int, score long, query_id long, vec string"
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, []), (3, [nan, 1.0]), (None, [1.0, 1.0]), (4, [0.5, 0.5]), (100, [1.0])]
    df = spark.createDataFrame([(i, v, 7, 7, 7, "x") for i, v in rows], schema)
    got = [tuple(r) for r in topk.exact_top_k(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert {q for q, *_ in got} == {0, 50} and sorted(v for q, _, v, _ in got if q == 50) == [0, 4]
    for some in (df.limit(0), df.where("vec_id = 4")):
        assert topk.exact_top_k(some.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark, docs, no_docs, tmp_path):
    """Null, empty and repeated rows, clashing names and an empty table through all stages."""
    for name, given in (("odd", docs), ("none", no_docs)):
        own = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, own, str(tmp_path))
            assert made.columns == given.columns
            path = str(tmp_path / f"{name}{len(list(tmp_path.iterdir()))}.parquet")
            made.write.parquet(path)
            own = spark.read.parquet(path)
        packed = corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path)).collect()
        ids = {r["doc_id"] for r in packed}
        assert ids <= {4, 7, 8, 9, 10, None} and {r["doc_id"] for r in own.collect()} == ids
        assert name == "odd" or not packed
