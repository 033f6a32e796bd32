"""Exact duplicates: any digest gives the groups of equal texts, in one batch or many."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact
from strandline.llm.filters import may_be_among
from strandline.llm.queries import ORACLES, QUERIES
from strandline.llm.storage import shared_folder
from tests.compare import duck, rows
from tests.llm.conftest import ODD, PLAIN, make


def weak(content):
    """A digest that many texts share."""
    return F.pmod(F.crc32(content), F.lit(7)).cast("string").cast("binary")


def check(found, given):
    """``found`` has the groups of ``given``, a list of (doc_id, text)."""
    same = defaultdict(list)
    for doc_id, text in given:
        same[text or ""].append(doc_id)
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n"], -1 if r["last"]["doc_id"] is None else r["last"]["doc_id"]) for r in found)
    number = lambda i: -1 if i is None else i
    assert ids == sorted((number(i), len(own), max(map(number, own))) for own in same.values() for i in own)
    assert sum(r["place"] == r["last"]["place"] for r in found) == len(same)


def test_query_equals_sql(spark, sf_dir):
    name = "op13_exact_dedup"
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir).sql(ORACLES[name]).df())


@pytest.mark.parametrize("digest", [exact.sha256, weak])
def test_many_batches_and_files_that_come_later(spark, tmp_path, digest):
    texts = [None, "", " ", "a", "A", "a ", "ä", "long " * 50_000, "long " * 50_000 + "x", PLAIN]
    given = [(None if i % 17 == 0 else i % 90, texts[i * i % 10] if i % 3 else texts[9]) for i in range(200)]
    table, folder = str(tmp_path / "t.parquet"), shared_folder(spark)
    config = exact.ExactConfig(digest=digest, batch_bytes=1000)
    seen = []
    for part in (given[:120], given[120:140], [], given[140:]):
        part_rows = spark.createDataFrame(part, "doc_id long, text string").selectExpr("*", "'z' AS place", "1 AS n", "2 AS digest")
        part_rows.repartition(3).write.mode("append").parquet(table)
        exact.update(spark, table, folder, config)
        seen += part
        check(exact.members(spark, table, folder, config).collect(), seen)
    # Nothing is counted twice.
    exact.update(spark, table, folder, config)
    check(exact.members(spark, table, folder, config).collect(), given)


@pytest.mark.parametrize("config", [exact.ExactConfig(), exact.ExactConfig(digest=weak, filter_bits=1 << 15)])
def test_odd_rows(spark, docs, no_docs, config):
    kept = exact.keep_one(docs, config)
    assert kept.columns == docs.columns and exact.keep_one(no_docs, config).count() == 0
    best = {}
    for i, text, *_ in ODD:
        best.setdefault(text or "", []).append(i)
    found = {r["text"] or "": r["doc_id"] for r in kept.collect()}
    assert len(found) == kept.count() and found == {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    same = make(spark, [(5, PLAIN, "en", "a")] * 40 + [(5, PLAIN + "x", "en", "a")])
    assert sorted(r["text"] for r in exact.keep_one(same, config).collect()) == [PLAIN, PLAIN + "x"]


def test_only_hits_are_read_again(spark, tmp_path):
    table = str(tmp_path / "t.parquet")
    spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS string) AS text").write.parquet(table)
    hits = spark.createDataFrame([("3",), ("70",)], "text string").select(exact.sha256(F.col("text").cast("binary")).alias("digest"))
    all_rows = spark.read.parquet(table).select("text", exact.sha256(F.col("text").cast("binary")).alias("digest"))
    passed = {r["text"] for r in may_be_among(hits, "digest")(all_rows).collect()}
    assert {"3", "70"} <= passed and len(passed) < 20
    full = may_be_among(all_rows.select("digest"), "digest", 1 << 15)(all_rows)
    assert full.count() == 20_000  # however few bits, no row that is there is lost
