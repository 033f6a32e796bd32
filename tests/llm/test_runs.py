"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import runs
from strandline.llm.queries import QUERIES
from tests.llm.conftest import ODD, PLAIN, make


def brute(words, least=24, repeats=3):
    """Every stretch of equal words q apart that is long enough and has no smaller period."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for q in range(1, len(ids) // repeats + 1):
        edges = np.diff(np.r_[0, (ids[:-q] == ids[q:]).astype(np.int8), 0])
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            own = ids[a : b + q]
            if len(own) >= max(least, repeats * q) and all((own[:-d] != own[d:]).any() for d in range(1, q)):
                out.append((int(a), len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


sequences = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9)), max_size=6).map(
    lambda parts: [x for own, times in parts for x in own * times]
)


@settings(max_examples=300, deadline=None)
@given(sequences, st.sampled_from([1, 5, 24]), st.sampled_from([3, 4]))
def test_runs_equal_brute_force(ids, least, repeats):
    assert runs.runs_of(np.array(ids, np.int64), runs.RunsConfig(least, repeats)) == brute(ids, least, repeats)


def test_long_periods_and_overlapping_runs():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 5000, 4000).tolist()
    inner = ([1, 2] * 9 + [3]) * 4
    ids = noise[:500] + noise[500:1100] * 3 + inner + noise[1100:] + [7] * 40
    assert runs.runs_of(np.array(ids)) == brute(ids)
    assert [r[2] for r in runs.runs_of(np.array(ids))] == [600, 19, 1]


def test_stretch_of_a_run_is_always_repeated():
    for least, repeats in ((1, 3), (24, 3), (30, 3), (24, 5)):
        k = runs.RunsConfig(least, repeats).stretch()
        assert k >= 1
        for q in range(1, 60):
            n = max(least, repeats * q)
            assert all(t + q <= n - k or t - q >= 0 for t in range(n - k + 1))
    assert runs.RunsConfig().stretch() == 9
    with pytest.raises(ValueError, match="three periods"):
        runs.RunsConfig(repeats=2)


def test_strongest_is_exact():
    big = 10**15
    assert runs.strongest([(0, 3 * big, big), (5, 3 * big + 1, big), (1, 3 * big + 1, big)]) == (5, 3 * big + 1, big)
    assert runs.strongest([(0, 30, 10), (0, 60, 20)]) == (0, 30, 10) and runs.strongest([]) is None


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    with_runs = 0
    for r in rows:
        words = planted((texts[r["doc_id"]] or "").encode().split(), r["doc_id"])
        found = brute(words)
        with_runs += bool(found)
        assert r["n_runs"] == len(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        gone = {i for a, b, c in found for i in range(a + c, a + b)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert with_runs > 10


def test_odd_rows(spark, docs, no_docs):
    def found(df):
        return df.select("doc_id", runs.find_runs(F.col("text")).alias("r")).select("doc_id", "r.*").collect()

    rows = found(docs)
    assert len(rows) == len(ODD) and found(no_docs) == []
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["runs"], r["strongest"], r["collapsed"]) == ([], None, "")
    text = "a\x0bb \xa0c " * 10 + "tail"
    one = found(make(spark, [(1, text, None, None), (1, text, None, None), (2, "the " * 400_000, None, None), (3, PLAIN * 4, None, None)]))
    assert one[0] == one[1] and tuple(one[0]["strongest"]) == (0, 30, 3) and one[0]["collapsed"] == "a b \xa0c tail"
    assert tuple(one[2]["strongest"]) == (0, 400_000, 1) and one[2]["collapsed"] == "the"
    assert one[3]["collapsed"].split() == PLAIN.split()
