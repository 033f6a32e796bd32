"""Results of the registered queries against brute force, on whole small tables."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import groups, langid, media, mixing, packing, passages, pii, shards, similar, simhash, storage, topk, toxicity
from strandline.llm.components import connected_components
from strandline.llm.queries import ORACLES, QUERIES
from tests.compare import duck, rows
from tests.llm.conftest import PLAIN, make
from tests.llm.test_rows import check_sequences


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir).sql(ORACLES[name]).df())


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_op1_on_held_out_rows(spark, sf_dir, documents):
    found = QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(found) == len(documents)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_word_first_backoff():
    a, b, c, d = np.log([[0.9, 0.1], [0.2, 0.8], [0.3, 0.7], [0.6, 0.4]]).tolist()
    model = langid.LangIdModel.of(["a", "b"], {"known": a}, {"_kn": b, "wn_": c, "x": d}, 3)
    scorer = langid.Scorer(model)
    assert np.allclose(scorer.of("known"), a)
    assert np.allclose(scorer.of("kn"), b)  # the only known 3-gram
    assert np.allclose(scorer.of("knwn"), np.mean([b, c], axis=0))
    assert np.allclose(scorer.of("axa"), d)  # down to a single letter
    assert not scorer.of("zzz").any()
    assert scorer.score(["KNOWN known"]) == scorer.score(["known  known"]) and scorer.score(["1_2", None, "²"]) == [("und", 0.0, 0.0)] * 3
    assert scorer.score(["known zzz kn axa"])[0][2] == pytest.approx((4 + 0 + 3 + 1) / 4)


def test_op1_scores_equal_brute_force(spark, sf_dir, documents):
    """Scores of all texts from the definition, with dictionaries of all words and n-grams."""
    counts = defaultdict(lambda: defaultdict(Counter))  # by length of n-grams, 0 for words; by language
    for i, d in documents.items():
        if zlib.crc32(str(i).encode()) % 5 and d["text"] is not None and d["lang"] is not None:
            for w in re.findall(r"[^\W\d_]+", d["text"].lower()):
                counts[0][d["lang"]][w] += 1
    languages = sorted(counts[0])
    for lang in languages:
        for w, k in counts[0][lang].items():
            for n in range(1, 6):
                for g in {f"_{w}_"[j : j + n] for j in range(len(w) + 3 - n)}:
                    counts[n][lang][g] += k
    units = {n: set().union(*counts[n].values()) for n in counts}
    total = {n: {x: sum(counts[n][x].values()) + 0.5 * len(units[n]) for x in languages} for n in counts}

    def of(w):
        for n, found in ((0, [w]), *((n, [f"_{w}_"[j : j + n] for j in range(len(w) + 3 - n)]) for n in range(5, 0, -1))):
            found = [g for g in found if g in units[n]]
            if found:
                return [sum(math.log((counts[n][x][g] + 0.5) / total[n][x]) for g in found) / len(found) for x in languages]
        return [0.0] * len(languages)

    for r in QUERIES["op1_language_id"](spark, sf_dir).collect():
        words = re.findall(r"[^\W\d_]+", (documents[r["doc_id"]]["text"] or "").lower())
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = [sum(x) / math.sqrt(len(words)) for x in zip(*map(of, words), strict=True)]
        odds = np.exp(np.array(sums) - max(sums))
        assert r["score"] == pytest.approx(odds.max() / odds.sum(), abs=1e-3)
        assert sums[languages.index(r["lang_pred"])] == pytest.approx(max(sums), abs=1e-3)


# Texts of languages that no labelled row has, and of none.
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "xqzvk jjwpt qqrst zzkvw bnmvc lkjhg fdsaq wrtyp xcvbn mnbvc qwrtp",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q Zm9vYmFyYmF6cXV4 U3BhcmtJc0dyZWF0 eHl6enlwbHVnaA",
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_language_stage_drops_other_languages_only(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    some = spark.createDataFrame([(-1 - i, t, None, None, None) for i, t in enumerate([*FOREIGN, None, "", "123 !!"])], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(some), "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect())


def test_language_stage_drops_labelled_junk(spark):
    """Random letters under a label are no evidence for themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = [(-1 - i, " ".join("".join(rng.choice(letters, int(n))) for n in rng.integers(3, 10, 60)), "en", None, None) for i in range(50)]
    kept = [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), "").select("doc_id").collect()]
    real = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert sum(i < 0 for i in kept) <= 5 and sum(i >= 0 for i in kept) >= 0.99 * real


@pytest.mark.parametrize("texts", [1, 1000])
def test_sample_of_rows_with_one_id(spark, texts):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % texts).alias("text"), F.lit("en").alias("lang"))
    assert 50 <= langid._labelled_sample(rows, 100).count() <= 100


def slow_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab Ä\n\x0b B", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode(), 3) == slow_fingerprint(text)


def test_op2_against_all_pairs(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in QUERIES["op2_simhash_near_dedup"](spark, sf_dir).collect()}
    ids = sorted(documents)
    assert sorted(found) == ids
    for i in ids:
        assert found[i]["fingerprint"] == f"{slow_fingerprint(documents[i]['text']):016x}"
    fps = [int(found[i]["fingerprint"], 16) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    roots = union_find(len(ids), links)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert {i: found[i]["component_id"] for i in ids} == {i: least[r] for i, r in zip(ids, roots, strict=True)}


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for b in base]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for config in (simhash.SimHashConfig(), simhash.SimHashConfig(group_rows=8), simhash.SimHashConfig(blocks=6, group_rows=16)):
        at = {int(v): i for i, v in enumerate(values.view(np.int64))}
        links = [(at[r["a"]], at[r["b"]]) for r in simhash.close_links(fps, config).collect()]
        assert all((int(values[a]) ^ int(values[b])).bit_count() <= 3 for a, b in links)
        every = [(a, b) for a in range(len(values)) for b in range(a) if (int(values[a]) ^ int(values[b])).bit_count() <= 3]
        got, want = union_find(len(values), links), union_find(len(values), every)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (600, 600)], "a long, b long")
    parts = defaultdict(set)
    for r in connected_components(edges).collect():
        parts[r["component"]].add(r["node"])
    assert sorted(map(len, parts.values())) == [1, 2, 201]


def test_op3_round_trip(spark, sf_dir, documents):
    config = media.AudioConfig()
    for r in QUERIES["op3_media_columns"](spark, sf_dir).collect():
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.wav(payload, config.rate)
        frames = 1 + max(0, -(-(-(-len(payload) * 3 // 4) - 150) // 60))
        assert r["feature"].startswith(f"{frames}:40:") and len(r["feature"].split(":")[2]) == 64
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()


def slow_feature(payload, config):
    """Resampling, log-mel and segments sample by sample in whole numbers."""
    samples = [b - 128 for b in payload]
    width = config.phases.shape[1]
    total = -(-len(samples) * config.up // config.down)
    sound = []
    for m in range(total):
        taps, base = config.phases[m * config.down % config.up].tolist(), m * config.down // config.up - config.lead
        value = sum(int(t) * samples[base + j] for j, t in zip(range(width), taps, strict=True) if 0 <= base + j < len(samples))
        sound.append((value + 32) // 64)
    frames = 1 + max(0, -(-(total - config.frame) // config.hop))
    sound += [0] * ((frames - 1) * config.hop + config.frame - total)
    waves, bank = config.waves.astype(int).tolist(), config.filterbank.astype(int).tolist()
    mels, energies = [], []
    for i in range(frames):
        cut = sound[i * config.hop : i * config.hop + config.frame]
        energies.append(sum(x * x for x in cut))
        both = [(sum(x * w[k] for x, w in zip(cut, waves, strict=True)) + 2048) // 4096 for k in range(len(waves[0]))]
        half = len(both) // 2
        power = [(a * a + b * b) // 64 for a, b in zip(both[:half], both[half:], strict=True)]
        mel = [sum(p * row[k] for p, row in zip(power, bank, strict=True)) for k in range(config.mels)]
        mels.append([math.floor(16 * math.log2(x + 1) + 1e-9) for x in mel])
    middle = sorted(energies)[(len(energies) - 1) // 2]
    on, state = [], False
    for e in energies:
        state = e * 10000 >= middle * config.enter if not state else e * 10000 >= middle * config.leave
        on.append(state)
    borders = [v for a in range(frames) if on[a] and (a == 0 or not on[a - 1]) for v in (a, next((b for b in range(a, frames) if not on[b]), frames) - 1)]
    digest = hashlib.sha256(np.array(mels, "<i2").tobytes() + np.array(borders, "<i8").tobytes()).hexdigest()
    return f"{frames}:{config.mels}:{digest}"


def test_op3_feature_equals_plain_loops(spark):
    config = media.AudioConfig()
    rng = np.random.default_rng(2)
    texts = ["", None, "a quiet text " * 40, "".join(map(chr, rng.integers(32, 1500, 700))), "ab" * 200 + "~~~~ÿÿÿÿ" * 60 + " " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["feature"] for r in media.audio_features(rows, config).collect()}
    assert got == {i: slow_feature(media.payload_of_text(t), config) for i, t in enumerate(texts)}


def test_op3_feature_depends_on_each_step(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(2).integers(32, 1500, 700)))
    feature = lambda config: media.features_of(text, config)[-1]
    usual = feature(media.AudioConfig())
    for name, at in (("phases", (1, 20)), ("waves", (40, 9)), ("filterbank", (9, 4))):
        config = media.AudioConfig()
        changed = getattr(config, name).copy()
        changed[at] += 40
        config.__dict__[name] = changed
        assert feature(config) != usual
    assert feature(media.AudioConfig(enter=10001)) != usual


def test_resampler_and_hysteresis():
    config = media.AudioConfig()
    time = np.arange(8000) / 8000
    # Whole numbers: rounding of samples and taps leaves half a percent.
    out = media.resampled(np.rint(127 * np.sin(2 * np.pi * 440 * time)), 0, 6000, config)
    assert np.abs(out / 16 - 127 * np.sin(2 * np.pi * 440 * np.arange(6000) / 6000))[100:5900].max() < 1
    wave = np.rint(127 * np.sin(time))
    assert np.array_equal(media.resampled(wave, 100, 200, config), media.resampled(wave, 0, 300, config)[100:200])
    assert media.active_frames(np.array([0, 5, 2, 2, 0, 2, 5.0]), 4, 1).tolist() == [False, True, True, True, False, False, True]
    text = PLAIN * 60
    blocks = media.AudioConfig(block_frames=7)
    for one, two in zip(media.log_mel(media.payload_of_text(text), config), media.log_mel(media.payload_of_text(text), blocks), strict=True):
        assert np.array_equal(one, two)
    table = media.from_ipc(media.features_of(text, config)[2])
    assert table["log_mel"].type.shape == [32, 40] and sum(table["frames"].to_pylist()) == len(media.log_mel(media.payload_of_text(text), config)[0])
    assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))


def test_op4_law(spark, sf_dir, documents):
    found = QUERIES["op4_sharding"](spark, sf_dir).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    old = Counter()
    for r in found:
        old[r["old_shard"]] += r["size"]
    moved = sum(r["size"] for r in found if r["old_shard"] != r["shard"])
    fewest = sum(max(0, old[i] - sum(sizes.values()) // 16) for i in range(16))
    assert moved <= fewest + 32 * largest


def test_cheapest_flow():
    cost = [[0, 2, 5], [2, 0, 1], [4, 3, 0]]
    flow = shards.cheapest_flow([7, 1, 1], [3, 3, 3], lambda i, j: cost[i][j])
    assert [sum(f) for f in flow] == [7, 1, 1] and all(sum(f[j] for f in flow) == 3 for j in range(3))
    # Three to the second for 2 each, whose own one goes on for 1, and one to the third for 5.
    assert sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(3)) == 12
    with pytest.raises(ValueError, match="hold"):
        shards.cheapest_flow([5], [4], lambda i, j: 0)


def test_rewrite_touches_affected_files_only(spark, tmp_path):
    docs = make(spark, [(i, "x" * (9 if i % 4 else 99), None, str(i % 4)) for i in range(80)])
    docs = docs.withColumns({c: F.lit(5) for c in ("shard", "slot", "old", "file", "chunk", "at", "new", "doc")}).repartition(6)
    config, doc = shards.ShardConfig(shards=4, chunk_rows=2), docs.schema
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    shards.write_shards(docs, (F.col("doc_id") % 4).cast("int"), old, config)
    ranges = shards.assign(spark, old, doc, config)
    shards.rewrite(spark, old, new, doc, ranges, config)
    found = shards.read_shards(spark, old, new, doc, ranges, config).collect()
    assert sorted((tuple(r["doc"]) for r in found), key=str) == sorted(map(tuple, docs.collect()), key=str)
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += len(r["doc"]["text"]) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 200 and all(sorted(r["slot"] for r in found if r["shard"] == j) == list(range(sum(r["shard"] == j for r in found))) for j in range(4))
    moved = {(r["old"], r["file"]) for r in shards.affected_files(ranges).collect()}
    assert {o for o, _ in moved} == {0} and spark.read.parquet(new).count() == sum(r["high"] - r["low"] + 1 for r in ranges.collect() if (r["old"], r["file"]) in moved)
    even = [(i, "x" * 9, None, str(i % 4)) for i in range(80)]
    assert all(r["old"] == r["shard"] for r in shards.reshard(make(spark, even), (F.col("doc_id") % 4).cast("int"), config).collect())


def test_op5_ids_and_places(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2] for i, d in documents.items()}
    found = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    for r in found:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
    check_sequences(found)
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    used = len({r["sequence_id"] for r in found})
    # No packing needs fewer than the tokens fill, or than there are pieces over half a sequence.
    least = max(math.ceil(sum(map(len, ids.values())) / 1024), sum(r["length"] > 512 for r in found))
    assert least <= used <= least * 1.03 + 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", " \n", ".", "don't", "12", "é", "日本", "<|endoftext|>", "²", " ", "\x1c", "_", "'s"]), max_size=14).map("".join))
def test_encoder_equals_the_tokenizer(text):
    own = packing.encoder(packing.default_tokenizer())
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.quick is not None and np.frombuffer(own.encode(text), dtype="<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_bins(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    number, offset = packing.pack_sizes(sizes, 100, 8)
    for b in set(number.tolist()):
        spans = sorted((int(offset[i]), int(sizes[i])) for i in np.flatnonzero(number == b))
        assert spans[0][0] == 0 and all(a + s == c for (a, s), (c, _) in zip(spans, spans[1:], strict=False)) and sum(s for _, s in spans) <= 100
    assert sorted(set(number.tolist())) == list(range(len(set(number.tolist()))))


def test_local_search_empties_a_bin():
    bins = packing.Bins(np.array([6, 6, 4, 3, 3, 2]), 12)
    bins.bin_of = np.array([0, 1, 0, 1, 2, 2])
    bins.fill = np.array([10, 9, 5])
    bins.improve(8)
    assert sorted(bins.fill.tolist()) == [0, 12, 12]


def test_op6_rates_hold_on_average(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = docs.crossJoin(spark.range(40)).withColumn("doc_id", F.col("doc_id") * 40 + F.col("id"))
    rate = {r["source"]: r["rate"] for r in mixing.rates(many).collect()}
    got = {r["source"]: r["n"] / r["m"] for r in mixing.replicate(many).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("m")).collect()}
    for s, r in rate.items():  # documents that are there have at least one copy
        assert got[s] == pytest.approx(r / (1 - math.exp(-r)), rel=0.2)
    mixed = mixing.mix(docs)
    assert mixed.rdd.mapPartitions(lambda rows: [[r["shuffle_key"] for r in rows]]).map(lambda k: k == sorted(k)).reduce(lambda a, b: a and b)


def test_op6_small_sources_reach_their_share(spark):
    # Ten sources of the same weight; "rare" has about 0.02 % of the characters, a rate of about 600.
    table = [(i, "x" * 99, None, f"s{i % 9}") for i in range(9000)] + [(9000 + i, "y" * 9, None, "rare") for i in range(15)]
    docs = make(spark, table)
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    assert rate["rare"] == pytest.approx(900_150 / 10 / 150)
    share = {r["source"]: r["share"] for r in mixing.realised_weights(mixing.mix(docs)).collect()}
    assert len(share) == 10 and all(s == pytest.approx(0.1, rel=0.15) for s in share.values())
    for rate in (0.7, 8.0, 50.0, 2000.0):
        first, cdf = mixing._distribution(rate)
        chance = np.diff(cdf, prepend=0)
        assert cdf[-1] == pytest.approx(1, abs=1e-9) and chance @ (first + np.arange(len(cdf))) == pytest.approx(rate, rel=1e-8)


def test_op7_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"  # smaller tables have too few labels to learn from
    documents = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = QUERIES["op7_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    one = [r["score"] for r in found if r["held_out"] and labels.get(r["doc_id"]) == 1]
    zero = [r["score"] for r in found if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert np.mean([a > b for a in one for b in zero]) + 0.5 * np.mean([a == b for a in one for b in zero]) > 0.9
    assert np.mean([s >= 0.7 for s in zero]) < 0.01


@pytest.mark.parametrize("seed", range(6))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    idf = rng.uniform(0.5, 3, 30)
    vectors = []
    for _ in range(300):
        at = np.unique(np.minimum(rng.geometric(0.12, rng.integers(0, 9)), 29))  # some terms are frequent
        vectors.append((at, rng.integers(1, 4, len(at)).astype(float)))
    config = toxicity.ToxicityConfig(block_rows=16)
    index = toxicity.BlockMaxIndex(np.arange(300), rng.integers(0, 2, 300), vectors, idf, config)
    assert 0 < (index.place >= 0).sum() < 30
    dense = np.zeros((300, 30))
    for i, (at, n) in enumerate(vectors):
        dense[i, at] = toxicity.unit_weights(at, n, idf)
    for i in range(40):
        for but in (int(np.flatnonzero(index.ids == i)[0]), None):
            rows_, cosines = index.nearest(*vectors[i], 7, but=but)
            want = dense @ dense[i]
            want[i] = 0 if but is not None else want[i]
            order = [j for j in np.lexsort((np.arange(300), -np.round(want, 9))) if want[j] > 0][:7]
            assert index.ids[rows_].tolist() == order and np.allclose(cosines, want[order])


def slow_toxicity(documents, labels, config):
    """Cosines of all pairs and votes, from the definition, for tables that are sampled whole."""
    words = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in documents.items()}
    ids = sorted(labels)
    there = Counter(labels.values())
    n = Counter(w for i in ids for w in words[i])
    ones = Counter(w for i in ids if labels[i] for w in words[i])
    vocabulary = sorted(w for w in n if n[w] >= 2)
    df = Counter(w for c in words.values() for w in c)
    weight = {w: (math.log((1 + len(documents)) / (1 + df[w])) + 1e-3) * math.log2(2 + ones[w] / there[1] / (max(n[w] - ones[w], 1) / there[0])) ** config.tone for w in vocabulary}

    def unit(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    units = {i: unit(c) for i, c in words.items()}

    def vote(i, but):
        cosines = [(sum(x * units[e].get(w, 0) for w, x in units[i].items()), e) for e in ids if e != but]
        near = sorted([(-round(c, 9), e, c) for c, e in cosines if c > 0])[: config.neighbours]
        one = sum(c for _, e, c in near if labels[e])
        return one / (sum(c for *_, c in near) + config.doubt), near

    raw = np.array([vote(i, i)[0] for i in ids])
    at, chance = toxicity.calibration(np.round(raw, 12), np.array([labels[i] for i in ids]), np.ones(len(ids)))
    return {i: (float(np.interp(vote(i, None)[0], at, chance)), [e for _, e, _ in vote(i, None)[1]]) for i in documents}


def test_op7_scores_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    common, rude = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)], ["idiot", "trash", "scum"]
    texts = {}
    for i in range(90):
        words = list(rng.choice(common, rng.integers(3, 25)))
        texts[i] = " ".join(words + (list(rng.choice(rude, 2)) if i % 3 == 0 else []))
    texts |= {90: None, 91: "", 92: "zzz unseen", 93: texts[3]}
    labels = {i: int(i % 3 == 0) for i in range(60)}
    docs = make(spark, [(i, t, None, None) for i, t in texts.items()])
    labelled = spark.createDataFrame(list(labels.items()) + [(0, 0), (1, None), (None, 1), (500, 1)], "doc_id long, toxic int")
    config = toxicity.ToxicityConfig(block_rows=8)
    want = slow_toxicity(texts, labels, config)
    found = {r["doc_id"]: r for r in toxicity.score(*toxicity.fit(docs, labelled.where("coalesce(doc_id, 0) <> 500"), config)).collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r["score"] == pytest.approx(want[i][0], abs=1e-6) and r["neighbour_ids"] == want[i][1]
    assert np.mean([found[i]["score"] for i in range(60, 90) if i % 3 == 0]) > 0.5 > np.mean([found[i]["score"] for i in range(60, 90) if i % 3])


def test_op7_repeated_ids_make_one_example(spark):
    rows_ = [(i % 5, f"alpha beta {'idiot' if i % 5 < 2 else 'gamma'} w{i % 5}", None, None) for i in range(50)]
    labelled = spark.createDataFrame([(i, int(i < 2)) for i in range(5)] * 3, "doc_id long, toxic int")
    model, counted = toxicity.fit(make(spark, rows_), labelled)
    assert sorted(model.index.ids.tolist()) == [0, 1, 2, 3, 4] and model.stands_for.tolist() == [1.0, 1.0] and counted.count() == 50


def test_op7_most_documents_have_terms(spark):
    found = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01")
    assert found.where("size(neighbour_ids) > 0").count() > 0.9 * found.count()


def test_calibration_rises():
    raw, label = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1])
    at, chance = toxicity.calibration(raw, label, np.ones(4))
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all() and len(at) == 3


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1+- ()0425b", max_size=40))
def test_plain_spans(text):
    assert pii.plain_spans(text) == base_spans(text)


def test_op8_over_the_table(spark, sf_dir, documents):
    for r in QUERIES["op8_pii"](spark, sf_dir).collect():
        want = base_spans(documents[r["doc_id"]]["text"] or "")
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x == i for _, x, _ in want) for i in range(4)]
        assert set(joined.split(",")) <= set(r["spans"].split(",")) or not joined


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john (at) example [dot] com now", ["john (at) example [dot] com"]),
        ("to jo at mail7 dot example dot com please", ["jo at mail7 dot example dot com"]),
        ("card four one one one one one one one one one one one one one one one ok", ["four one one one one one one one one one one one one one one one"]),
        ("call plus four nine one five one two three four five six seven eight", ["plus four nine one five one two three four five six seven eight"]),
        ("jоhn＠examplе.com!", ["jоhn＠examplе.com"]),
        ("ip 10 dot 0 dot 0 dot 1", ["10 dot 0 dot 0 dot 1"]),
        ("see john.smith at gmail.com", []),
        ("one two three of them are at that dot", []),
        ("a@b.c and １２ x", ["a@b.c"]),
        ("host one nine two dot one six eight dot one dot one", ["one nine two dot one six eight dot one dot one"]),
        ("to 𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.com", ["𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.com"]),
        ("call +①②③ ④⑤⑥ ⑦⑧⑨⓪.", ["+①②③ ④⑤⑥ ⑦⑧⑨⓪"]),
        ("call plus 4 nine 1 five 1 two 3 four five six", ["plus 4 nine 1 five 1 two 3 four five six"]),
        ("is j o h n @ e x a m p l e . c o m ok", ["j o h n @ e x a m p l e . c o m"]),
        ("ফোন +৪৯১৫১২৩৪৫৬৭৮", ["+৪৯১৫১২৩৪৫৬৭৮"]),
        ("jоhn@example.com", ["jоhn@example.com", "hn@example.com"]),
        ("john@example.cоm", ["john@example.cоm", "john@example.c"]),
        ("mail john @ example . com", ["john @ example . com"]),
        ("mail john@example dot co dot uk, ok", ["john@example dot co dot uk"]),
        ("mail jo dot smith at mail dot ru.", ["jo dot smith at mail dot ru"]),
        ("look at the dot in the sky, at a dot com", []),
        ("x\u200by@exa\xadmple.com", ["x\u200by@exa\xadmple.com"]),
        ("Größe für 12 Straßen, déjà vu", []),
    ],
)
def test_disguises(text, found):
    every = pii.spans_of(text)[1]
    assert sorted(text[a:b] for a, _, b in every) == sorted(found)
    assert set(pii.spans_of(text)[0]) <= set(every)
    left = pii.redacted(text)
    assert not any(x in left for x in found)


@pytest.mark.parametrize("unit", [" ", "a dot ", "1", "1 ", "a at b dot com ", "( ", "one ", "one dot ", "a@", "+1", "1.", " . ", "аб", "a\u200b", "+1(((", "x @ ", "-", "a.", "[at", "at "])
def test_pii_takes_time_in_proportion(unit):
    text = "a (at) b " + unit * (1_000_000 // len(unit)) + " (at)"
    began = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - began < 8  # quadratic ones take hours


def test_redaction_of_spans_within_spans():
    assert pii.redacted("to jоhn@example.com and john@example.cоm.") == "to [EMAIL] and [EMAIL]."
    assert pii.redacted("card 4111 1111 1111 1111, +4111111111111 x") == "card [CARD], [PHONE] x"


def test_op9_finds_planted_passages(spark):
    rng = np.random.default_rng(5)
    syllables = ["ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ra", "si", "tu", "ve"]

    def prose(n, every=9):
        out = []
        for i in range(n):
            out.append("".join(rng.choice(syllables, rng.integers(1, 4))) + str(rng.integers(0, 50)) + ("." if i % every == every - 1 else ""))
        return out

    passage, near = prose(60), prose(120)
    changed = [*near]
    changed[60] = "other"
    table = []
    for i in range(60):
        words = prose(150)
        if i % 5 == 0:
            words[70:70] = passage
        if i in (1, 2):
            words[40:40] = near if i == 1 else changed
        table.append((i, " ".join(words), "en", "s"))
    docs = make(spark, table)
    found = passages.shared_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(60) if i % 5 == 0} | {1, 2}
    assert {r["doc_id"] for r in found if r["removed"]} == {i for i in range(5, 60, 5)} | {2}
    for r in found:
        at = 40 if r["doc_id"] in (1, 2) else 70
        # A similar paragraph may go on for a few words after the passage.
        assert r["start_word"] >= at and r["end_word"] <= at + (120 if r["doc_id"] in (1, 2) else 60) + 10
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert left[3] == table[3][1] and left[0] == table[0][1] and len(left[5].split()) < 190
    assert passages.PassageConfig().bands() == 3 and passages.PassageConfig(band_rows=2).bands() == 5
    assert passages.without_words("a  b\nc d", [(1, 3)]) == "a  \n d"


def longest_shared_runs(texts, words=8):
    """Of each text the words of its longest run whose every ``words`` neighbours another document has, and how many differ in it."""
    owner, shared, grams = {}, set(), {}
    for i, t in texts.items():
        parts = (t or "").encode().split()
        grams[i] = parts, [b" ".join(parts[j : j + words]) for j in range(len(parts) - words + 1)]
        for g in set(grams[i][1]):
            if owner.setdefault(g, i) != i:
                shared.add(g)
    out = {}
    for i, (parts, own) in grams.items():
        best, run, at = 0, 0, 0
        for j, g in enumerate(own):
            run = run + 1 if g in shared else 0
            if run > best:
                best, at = run, j
        out[i] = (best + words - 1, len(set(parts[at - best + 1 : at + words]))) if best else (0, 0)
    return out


def test_op9_recall_and_precision_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    runs = longest_shared_runs(texts)
    wanted = {i for i, (n, varied) in runs.items() if n > 50 and varied > 15}
    copies = Counter(" ".join((t or "").split()) for t in texts.values())
    copied = {i for i, t in texts.items() if copies[" ".join((t or "").split())] > 1 and len((t or "").split()) >= 7}
    found = {r["doc_id"] for r in QUERIES["op9_substring_dedup"](spark, sf_dir).collect()}
    assert len(wanted & found) >= 0.98 * len(wanted) > 50
    assert len(copied & found) >= 0.98 * len(copied) > 50
    clean = {i for i, (n, _) in runs.items() if n < 20} - copied
    assert len(clean & found) <= 0.005 * len(clean)


def test_op9_copies_and_heads_without_sentences(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 5))
    copy, head, dialogue = [word() for _ in range(15)], [word() for _ in range(30)], [word() for _ in range(72)]
    talk = " ".join(w + ("!" if i % 6 == 5 else "") for i, w in enumerate(dialogue))
    table = [(i, " ".join(copy)) for i in range(5)]
    table += [(10 + i, " ".join(head) + ". " + " ".join(word() for _ in range(50))) for i in range(5)]
    table += [(20 + i, " ".join(word() for _ in range(40 + i)) + " " + talk + " " + " ".join(word() for _ in range(40))) for i in range(5)]
    table += [(100 + i, " ".join(word() for _ in range(rng.integers(8, 40)))) for i in range(60)]
    unlike = len(table)
    table += [(1000 + i, t) for i, (_, t) in enumerate(table[15:])]  # copies of texts without a sentence end
    docs = make(spark, [(i, t, None, None) for i, t in table])
    found = {r["doc_id"]: r for r in passages.shared_passages(docs).collect()}
    assert found.keys() == {i for i, _ in table} and unlike == 75
    assert (found[0]["start_word"], found[0]["end_word"]) == (0, 15) and found[10]["start_word"] == 0 and found[10]["end_word"] >= 24


def slow_jaccard(a, b, words=5):
    one, two = ({tuple(x[i : i + words]) for i in range(len(x) - words + 1)} for x in (a, b))
    return len(one & two) / len(one | two)


def test_op9_links_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 4))
    texts = []
    for g in range(150):  # one paragraph each, without sentences; every other group differs in its last words
        base = [word() for _ in range(13)]
        texts += [[*base], [*base[: 12 if g % 3 else 9], *[word() for _ in range(1 if g % 3 else 4)]]]
    docs = make(spark, [(i, " ".join(t), None, None) for i, t in enumerate(texts)])
    cut = [passages.cut([" ".join(t).encode()], passages.PassageConfig()) for t in texts]
    whole = [t[c.start[i] : c.end[i]] for t, c in zip(texts, cut, strict=True) for i in range(len(c.start))]
    owner = [(j, int(c.start[i])) for j, c in enumerate(cut) for i in range(len(c.start))]
    want = set()
    for i in range(len(whole)):
        for j in range(i):
            if owner[i][0] != owner[j][0] and slow_jaccard(whole[i], whole[j]) >= 0.8:
                want |= {owner[i], owner[j]}
    got = passages.repeated_paragraphs(docs).join(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id"), "row")
    got = {(r["doc_id"], r["start"]) for r in got.collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 150


def test_similar_paragraphs_of_a_crowded_key(spark):
    config = passages.PassageConfig(group_rows=8)
    words = [f"w{i}" for i in range(40)]
    table = [(i, " ".join([*words[:20], f"x{i}", *words[20:]]), None, None) for i in range(40)]
    docs = make(spark, table)
    assert {r["doc_id"] for r in passages.shared_passages(docs, config).collect()} == {r["doc_id"] for r in passages.shared_passages(docs).collect()}


def test_op10_ties_copies_and_bad_vectors(spark):
    vectors = [[float(i % 3), 1.0] for i in range(60)]
    table = [(i, v) for i, v in enumerate(vectors)] + [(200, [float("nan"), 1.0]), (201, None), (202, [None, 1.0]), (None, [9.0, 9.0]), (250, [1.0]), (300, [5.0, 1.0]), (300, [5.0, 1.0]), (1, [0.0, 50.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, topk.TopKConfig(query_rows=3, score_rows=2, candidate_rows=7, bins=4, few=2)).collect()
    usable = [(i, np.floor(256 * np.array(v))) for i, v in table if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, qv in {i: v for i, v in usable if i % 50 == 0}.items():
        want = sorted(((-int(qv @ v), i) for i, v in usable if i != q and len(v) == len(qv)))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_op10_better_vectors_above_a_refined_bin(spark):
    # With the query's [256, 1], a vector [a, b] scores 256 a + b: many close scores, and a few better ones just above.
    scores = [(40_000 + g * 1500 + i % 97, 10_000 * g + i + 1) for g in range(6) for i in range(300)]
    queries = [(0, [1.0, 1 / 256])]
    for top in range(6):
        table = [(s, i) for s, i in scores if s < 40_000 + top * 1500 + 100] + [(40_000 + top * 1500 + 130 + 90 * j, 90_001 + j) for j in range(3)]
        df = spark.createDataFrame(queries + [(i, [s // 256 / 256, s % 256 / 256]) for s, i in table], "vec_id long, embedding array<float>")
        got = topk.exact_top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
        want = sorted((-s, i) for s, i in table)[:5]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_pipeline_stages(spark, sf_dir, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, d in documents.items() if re.search(r"[^\W\d_]", d["text"] or "")}
    ids = sorted(documents)
    safe = {r["doc_id"]: r["text"] for r in stages["pii_redaction"](spark, docs, sf_dir).collect()}
    assert len(safe) == len(ids) and all((safe[i] == documents[i]["text"]) == (not pii.spans_of(documents[i]["text"])[1]) for i in ids)
    assert not any(base_spans(t) for t in safe.values())
    mixed = stages["source_mixing"](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(ids)
    check_sequences(packing.pack(mixed).collect())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def shingle_set(text, words=5):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def kept_by_jaccard(texts):
    """The least ids of the components of pairs of Jaccard 0.8 or more, by all pairs."""
    ids = sorted(texts)
    sets = [shingle_set(texts[i]) for i in ids]
    close = [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = {}
    for i, r in zip(ids, union_find(len(ids), close), strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def test_pipeline_drops_pairs_of_jaccard_08(spark):
    sf_dir = "/root/testdata/sf0.01"  # of the pairs there, some are over 3 bits apart
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf_dir)
    assert once.columns == docs.columns
    assert sorted(r["doc_id"] for r in once.collect()) == kept_by_jaccard({r["doc_id"]: r["text"] for r in docs.collect()})


def test_similar_sets_of_a_crowded_key(spark):
    docs = make(spark, [(i, t, None, None) for i, t in crowded_texts().items()])
    few = similar.SimilarConfig(group_rows=8, pivots=1)
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs, few).collect()) == kept_by_jaccard(crowded_texts())


def crowded_texts():
    """Many texts of one origin, some alike, some below the limit."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    out = {}
    for i in range(90):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[j] = f"x{i}_{j}"
        out[i] = " ".join(words)
    return out


def test_keys_of_the_same_nodes_are_compared_once(spark):
    table = [("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("c", 3, 1), ("d", 1, 1), ("d", 2, 2), ("d", 3, 1)]
    rows = groups.keys_to_compare(spark.createDataFrame(table, "key string, node long, component long"), "node").collect()
    assert sorted(map(tuple, rows)) == [("a", 2), ("d", 3)]


def test_a_shared_passage_makes_no_candidates(spark):
    """Sets of one key that have three in five shingles in common, all of different components: what is made grows in proportion."""
    made = {}
    for n in (300, 1200):
        common = np.arange(1, 61, dtype=np.uint64) << np.uint64(32)
        sets = [np.unique(np.r_[common, similar._mixed(np.arange(i * 40 + 1, i * 40 + 41, dtype=np.uint64))]) for i in range(n)]
        sets += [np.r_[s[:-1], s[-1] + np.uint64(1)] for s in sets[:5]]
        rows = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "content long, component long, shingles binary")
        met = similar.groups_by_rarest(rows)
        made[n] = met.count()
        assert sorted(tuple(sorted(r)) for r in similar.links_across(met, rows).collect()) == [(i, n + i) for i in range(5)]
    assert made[1200] <= 4 * made[300]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.integers(0, 99))
def test_similar_sets_have_a_rare_shingle_in_common(one, two, seed):
    counts = np.random.default_rng(seed).integers(0, 4, 16)
    x, y = (np.array(sorted(z), np.uint64) for z in (one, [*one[: len(one) - len(one) // 8], *two[:1]]))
    y = np.unique(y)
    both = len(np.intersect1d(x, y))
    if both >= 0.8 * (len(x) + len(y) - both):
        assert len(np.intersect1d(similar.rarest(x, counts, 0.8), similar.rarest(y, counts, 0.8)))


def test_nodes_of_different_components_meet(spark):
    table = [("a", i, 1) for i in range(50)] + [("a", 100 + i, 2 + i % 9) for i in range(21)] + [("b", i, 5) for i in range(40)] + [("c", i, i) for i in range(5)]
    rows = groups.dealt_across(spark.createDataFrame(table, "key string, node long, component long"), "node", 8).collect()
    together = {}
    for r in rows:
        together.setdefault(r["group"], []).append(r["node"])
    assert max(map(len, together.values())) <= 24
    met = {(x, y) for g in together.values() for x in g for y in g}
    for key in "abc":
        own = [(n, c) for k, n, c in table if k == key]
        assert all((x, y) in met for x, cx in own for y, cy in own if cx != cy)


def test_similar_sets_at_the_limit_and_by_steps(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    table = {}
    for i in range(60):  # more and more words differ at the end, so some pairs are alike only by steps
        table[i] = " ".join([*base[: 200 - 3 * i], *[f"n{j}" for j in range(3 * i)]])
    for i in range(60, 90):
        table[i] = " ".join([*base[:150], *[f"o{i}_{j}" for j in range(int(rng.integers(1, 60)))]])
    table |= {90: "a b c", 91: "A  b\nc", 92: "a b d", 93: "", 94: None, 95: " "}
    docs = make(spark, [(i, t, None, None) for i, t in table.items()])
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == kept_by_jaccard(table)
    odd = make(spark, [(None, "x", None, None), (5, "x", None, None), (5, "x", None, None), (None, "y", None, None)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in similar.drop_similar(odd).collect()) == [(0, "y"), (5, "x")]
    assert similar.drop_similar(docs.where("false")).count() == 0


def slow_blocks(shingles, count):
    """The blocks of a SimHash, bit by bit: 64 bits a seed, set in over half of the hashes, the lowest first."""
    out = []
    for seed in similar._mixed(np.arange(1, count // 4 + 1, dtype=np.uint64)):
        hashes = [int(h) for h in similar._mixed(shingles ^ seed)]
        bits = [2 * sum(h >> i & 1 for h in hashes) > len(hashes) for i in range(64)]
        out += [sum(bits[16 * j + i] << i for i in range(16)) for j in range(4)]
    return out


def test_near_duplicates_of_the_pipeline_come_from_simhash(spark):
    config = similar.SimilarConfig()
    texts = crowded_texts() | {200 + i: f"some words of {i} are here alone, and {i * i} too" for i in range(40)} | {300: "a b", 301: "A  b"}
    sets = {i: similar.shingles_of(t.encode(), 5) for i, t in texts.items()}
    prints = {i: similar.fingerprint_of(s, config) for i, s in sets.items()}
    for i in (0, 200, 300):
        assert prints[i].tolist() == slow_blocks(sets[i], config.blocks)
    # All pairs that share one of the blocks and differ in few bits meet, in crowded blocks too.
    rows = [(i, p.view(np.int16).tolist(), *map(int, p[:8].view(np.int64)), i) for i, p in prints.items() if i != 301]
    table = spark.createDataFrame(rows, "content long, blocks array<smallint>, mark0 long, mark1 long, component long")
    want = [(i, j) for i in prints for j in prints if i < j < 301 and (prints[i] == prints[j])[32:64].any() and np.bitwise_count(prints[i][:8] ^ prints[j][:8]).sum() <= 40]
    for near_rows in (8, 512):
        keys = {}
        for r in similar.near_groups(table, 32, similar.SimilarConfig(near_rows=near_rows)).collect():
            keys.setdefault(r["content"], set()).add(r["key"])
        assert len(want) > 500 and all(keys.get(i, set()) & keys.get(j, set()) for i, j in want)
    # Without close fingerprints only equal sets are one.
    docs = make(spark, [(i, t, None, None) for i, t in texts.items()])
    kept = [r["doc_id"] for r in similar.drop_similar(docs, similar.SimilarConfig(most_bits=-1)).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(texts) - {301})


def test_op9_bands_collide_one_at_a_time(spark, monkeypatch):
    """No shuffle has the keys of several bands, and what collides is what plain counting finds."""
    rng = np.random.default_rng(3)
    names = passages._band_names(passages.PassageConfig())
    table = [(i, int(rng.integers(0, 30)), int(rng.integers(30, 60)) if i % 3 else 0, *(1000 * b + int(rng.integers(0, 150)) for b in range(len(names)))) for i in range(200)]
    table = [(c, low, high or low, *keys) for c, low, high, *keys in table]
    plans = []
    real = passages.written
    monkeypatch.setattr(passages, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    contents = spark.createDataFrame(table, "content long, low long, high long, " + ", ".join(f"{n} long" for n in names))
    held = {}
    for c, low, high, *keys in table:
        for k in keys:
            held.setdefault(k, []).append((c, low, high))
    want = sorted((k, c, len(v)) for k, v in held.items() if len(v) > 1 and min(x[1] for x in v) != max(x[2] for x in v) for c, _, _ in v)
    found = passages._colliding(contents, passages.PassageConfig())
    assert sorted((r["key"], r["content"], r["count"]) for r in found.collect()) == want
    assert len(plans) == len(names) + 1 and not any("Generate" in p for p in plans)


def test_near_duplicates_leave_little_on_the_driver(spark, monkeypatch):
    """What a step's plan left is released before the next one, and no table of counters is made where no key is crowded."""
    done, paths = [], []
    real, release = storage.written, storage.release
    monkeypatch.setattr(storage, "written", lambda df: done.append("written") or real(df))
    monkeypatch.setattr(storage, "release", lambda df: done.append("release") or release(df))
    monkeypatch.setattr(similar, "groups_by_rarest", lambda *a: paths.append(a))
    texts = {i: t for i, t in crowded_texts().items() if i < 12} | {100: "a b", 101: "A  b"}
    docs = make(spark, [(i, t, None, None) for i, t in texts.items()])
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == kept_by_jaccard(texts)
    assert not paths
    assert done.count("written") > 20 and "written written" not in " ".join(done)


def family_texts(n):
    """Texts with two or three words of their own each: close to each other in many blocks, most pairs below the limit; a copy of each tenth has one more."""
    rng = np.random.default_rng(17)
    out = {}
    for i in range(n):
        words = [f"w{j}" for j in range(120)]
        for j in rng.choice(120, int(rng.integers(2, 4)), replace=False):
            words[j] = f"x{i}_{j}"
        out[i] = " ".join(words)
        if i % 10 == 0:
            out[n + i] = " ".join([*words[:60], f"y{i}", *words[61:]])
    return out


def test_a_family_of_texts_below_the_limit_goes_on_under_few_keys(spark, monkeypatch):
    """What is close in many blocks and stays apart meets once by its rarest shingles, not again under each block, and is verified with few others."""
    texts, made = family_texts(120), []
    real = similar.settled

    def counted(df):
        out = real(df)
        if {"key", "a"} & set(out.columns) and "shingles" not in out.columns:
            made.append((out.count(), out.columns))
        return out

    monkeypatch.setattr(similar, "settled", counted)
    docs = make(spark, [(i, t, None, None) for i, t in texts.items()])
    assert sorted(r["doc_id"] for r in similar.drop_similar(docs).collect()) == kept_by_jaccard(texts)
    assert max(made)[0] <= 40 * len(texts), max(made)


def test_each_set_is_held_against_few_pivots(spark):
    config = similar.SimilarConfig()
    rng = np.random.default_rng(23)
    rows = [(k, int(c), 100, int(c)) for k in range(150) for c in rng.choice(300, 40, replace=False)]
    near = lambda size, other: F.expr(f"{size} = {other}")
    pairs = [tuple(r) for r in similar.pivot_pairs(spark.createDataFrame(rows, "key int, content long, size int, component long"), near, config).collect()]
    under = {}
    for k, c, _, _ in rows:
        under.setdefault(c, set()).add(k)
    assert len(pairs) == len(set(pairs)) <= config.pivots * len(under) and all(a < b and under[a] & under[b] for a, b in pairs)
    assert {x for p in pairs for x in p} == set(under)


def test_sets_of_a_key_go_the_same_way(spark):
    config = similar.SimilarConfig(group_rows=8)
    # Content 0 is under five keys; keys 0 to 4 share it. Key 5 is crowded. Keys 6 and 7 are neither; key 8 is of one component.
    rows = [(k, c, c) for k in range(5) for c in (0, 10 + k)] + [(5, c, c) for c in range(20, 30)] + [(6, 10, 10), (6, 40, 40), (7, 41, 41), (7, 42, 42), (8, 50, 1), (8, 51, 1)]
    few, many = similar.apart(spark.createDataFrame(rows, "key long, content long, component long"), 16, config)
    assert sorted(map(tuple, few.select("key", "content", "component").collect())) == [(6, 10, 10), (6, 40, 40), (7, 41, 41), (7, 42, 42)]
    assert sorted(map(tuple, many.collect())) == [(c, c) for c in [0, *range(10, 15), *range(20, 30)]]


def test_language_model_holds_no_string_for_each_row():
    rows, names = 200_000, ["de", "en", "fr"]
    langs = pa.array(names * (rows // 3))
    table = pa.table({"lang": langs, "n": pa.array((np.arange(len(langs)) // 3 % 6).astype(np.int32)), "key": pa.array(np.arange(len(langs)) // 3), "count": pa.array(np.arange(len(langs)) % 3 + 1)})
    tracemalloc.start()
    model = langid._model(table, langid.LangIdConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == names and len(model.words) + len(model.grams) == len(langs) // 3
    shares = np.exp(model.word_scores).sum(axis=0)
    assert np.allclose(shares, 1, atol=1e-3) and (np.diff(model.words) > 0).all()
    assert peak < 50 * len(langs)
