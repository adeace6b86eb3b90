"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import (
    covering_simhash,
    impact_index,
    jump_shards,
    langmix,
    mixture_tree,
    prefix_bpe,
    quality_gbdt,
    repetition,
    toxicity,
    warc,
)
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size long"


def docs_of(spark, *texts, lang="en"):
    """A documents table with extra columns whose names clash, and one row for each text."""
    rows = [(i, t, lang, None if i % 4 == 3 else f"s{i % 2}", 0, 9.0, 99, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [None, "", " \n\t ", "one", "one two", "Ünïcode wörds ß 日本語 \U0001f600 end", LONG, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    d = docs_of(spark, *ODD)
    return d.unionAll(d.where("doc_id = 3")).unionAll(d.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))


# --- 1: quality ----------------------------------------------------------------------------------------------


def test_quality_edges(spark, odd):
    forest = quality_gbdt.train(spark, table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = quality_gbdt.score(odd, forest).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert quality_gbdt.score(odd.limit(0), forest).collect() == []
    assert quality_gbdt.keep(odd, forest).schema == odd.schema
    bare = quality_gbdt.train(spark, odd.limit(0), table(spark, SF, "labels"))
    assert {r.score for r in quality_gbdt.score(odd, bare).collect()} == {0.5}


def test_forest_matches_a_plain_walk():
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(400, 5)), rng.normal(size=400)
    forest = quality_gbdt.fit(x, (x[:, 0] + 0.3 * noise > 0).astype(float), trees=10)
    for row, got in zip(x[:50], forest.predict(x[:50]), strict=True):
        margin = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((forest.predict(x) > 0.5) == (x[:, 0] > 0)).mean() > 0.85


# --- 2: repetition -------------------------------------------------------------------------------------------


def brute_repetition(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(len(w.decode()) for w in words), symbols, dup, len(inside)


def test_repetition_is_exact(spark, odd):
    rng = random.Random(3)
    made = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 3) + "x # y\nx # y" for _ in range(200)]
    for text in [*ODD, *made]:
        m = repetition.measure(text)
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert got == brute_repetition(text)
        assert m["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (m["kept"] and m["base_failed"])
    assert repetition.repetition_rules(odd).count() == odd.count()
    assert repetition.repetition_rules(odd.limit(0)).collect() == []


def test_colliding_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(repetition, "_mixed", lambda codes: np.zeros(len(codes), np.uint64))
    codes = repetition._codes(b"a b c d e f a b c d e g".split())
    assert repetition.repeated_windows(codes, 5).tolist() == [True] + [False] * 5 + [True, False]


# --- 3: WARC -------------------------------------------------------------------------------------------------


def test_warc(spark):
    h, tricky = "x" * 150, "WARC/1.1\r\n\r\n\r\n\r\nß" * 20
    rows = [(1, "u", h), (2, "u\r\nv", h), (3, None, h), (0, "a", None), (7, "a", ""), (8, "b", tricky), (9, "b", tricky), (9, "b", tricky), (None, "q", h), (5, "s", "short"), (6, "s", "short")]
    pages = spark.createDataFrame([(*r, 9, "z") for r in rows], "page_id long, url string, html string, record_type int, payload string")
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    first = {h: 1, tricky: 8}
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = first[html] if html in first and page != first[html] else None
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_payloads_come_back(spark, tmp_path):
    pages = table(spark, SF, "pages")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=True))
    back = {r.page_id: bytes(r.p).decode() for r in captures.select("page_id", F.col("response.payload").alias("p")).collect()}
    assert back == {r.page_id: r.html for r in pages.collect()}


def test_warc_damage_is_noticed():
    with pytest.raises(warc.WarcError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


# --- 4: top k ------------------------------------------------------------------------------------------------


def brute_top(vectors, k=20, every=20):
    rows = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            rows.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    queries = {}
    for i, v in rows:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = Counter()
    for q, own in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:k]
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(-40, 400)]
    vectors += [(500 + i, vectors[0][1]) for i in range(30)]  # ties
    vectors += [(20, vectors[60][1]), (33, vectors[61][1]), (33, vectors[61][1]), (900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (None, vectors[0][1]), (905, [1.0, 2.0]), (920, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, least int, no string")
    assert Counter(tuple(r) for r in impact_index.top_k(df).collect()) == brute_top(vectors)
    assert impact_index.top_k(df.limit(0)).collect() == []
    few = [v for v in vectors if v[0] in (0, 1, 2)]
    assert Counter(tuple(r) for r in impact_index.top_k(df.where("vec_id in (0, 1, 2)")).collect()) == brute_top(few)


def test_top_k_of_many_blocks_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "BLOCK", 64)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * (1e7 if i % 7 == 0 else 1)]) for i in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in impact_index.top_k(df).collect()) == brute_top(vectors)


def test_top_k_stops_on_proof():
    rng = np.random.default_rng(3)
    centre = rng.integers(-60, 60, size=(10, 64))
    vectors = np.clip(centre[rng.integers(0, 10, 3000)] + rng.integers(-3, 4, (3000, 64)), -64, 64).astype(np.int64)
    index = impact_index.Index.build(np.arange(3000), vectors)
    rescored = []
    monkey = index._best
    index._best = lambda members, *a: (rescored.append(len(members)), monkey(members, *a))[1]
    for q in range(5):
        ids, scores = index.search(vectors[q], q, 20)
        true = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(3000), -true)) if i != q][:20]
        assert ids.tolist() == order and scores.tolist() == true[order].tolist()
    assert max(rescored) < 3000 and index.used < 0.8 * index.asked


def test_a_known_bound_changes_no_result():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-30, 30, size=(2000, 16))
    index = impact_index.Index.build(np.arange(2000) // 2, vectors)  # two members a vec_id
    for q in range(20):
        true = np.where(np.arange(2000) // 2 == q, -(10**9), vectors @ vectors[2 * q])
        kth = int(np.sort(true)[-20])
        for least in (None, kth - 500, kth, kth + 1, 10**6):
            ids, scores = index.search(vectors[2 * q], q, 20, least)
            want = [(-s, i) for s, i in zip(true.tolist(), (np.arange(2000) // 2).tolist()) if s > -(10**9) and (least is None or s >= least)]
            assert list(zip((-scores).tolist(), ids.tolist())) == sorted(want)[:20]


def test_top_k_leaves_most_postings_unread_without_clusters():
    rng = np.random.default_rng(11)
    unit = rng.normal(size=(4000, 64))
    vectors = np.floor(64 * unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.int64)
    index = impact_index.Index.build(np.arange(4000), vectors)
    rescored, best = [], index._best
    index._best = lambda members, *a: (rescored.append(len(members)), best(members, *a))[1]
    for q in range(20):
        true = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(4000), -true)) if i != q][:20]
        for least in (None, int(true[order[-1]])):
            ids, scores = index.search(vectors[q], q, 20, least)
            assert ids.tolist() == order and scores.tolist() == true[order].tolist()
    assert index.used < 0.4 * index.asked and max(rescored) <= 1000


@pytest.mark.parametrize("kind", ["wide", "tail", "constant", "sparse", "one id"])
def test_search_equals_plain_products(kind):
    rng = np.random.default_rng(12)
    n, d, ids = 700, 12, np.arange(700)
    if kind == "wide":  # steps of many values
        vectors = rng.integers(-40_000, 40_000, (n, d))
    elif kind == "tail":  # a few long vectors
        vectors = np.floor(rng.normal(size=(n, d)) * np.where(rng.random((n, 1)) < 0.05, 1e6, 3)).astype(np.int64)
    elif kind == "constant":
        vectors = np.tile(rng.integers(-5, 6, d), (n, 1))
    elif kind == "sparse":
        vectors = rng.integers(-50, 50, (n, d)) * (rng.random((n, d)) < 0.05)
    else:  # fewer than k members are not the query's own
        vectors, ids = rng.integers(-30, 30, (n, d)), np.where(np.arange(n) < 10, np.arange(n), 99)
    index = impact_index.Index.build(ids, vectors)
    for q in range(0, n, 70):
        for w in (vectors[q], -vectors[q], np.zeros(d, np.int64)):
            true, fit = vectors @ w, np.flatnonzero(ids != ids[q])
            order = fit[np.lexsort((ids[fit], -true[fit]))][:20]
            for least in (None, int(true[order[-1]]) - 1, int(true[order[-1]]), int(true[order[0]])):
                want = [i for i in order if least is None or true[i] >= least]
                found, scores = index.search(w, int(ids[q]), 20, least)
                assert found.tolist() == ids[want].tolist() and scores.tolist() == true[want].tolist()


def test_each_block_has_a_task_of_its_own(spark):
    schema = "block long, n int, d int, ids binary, rows binary, least array<long>, no int"
    one = lambda no, i: (no, 1, 1, np.array([i], np.int64).tobytes(), b"\x01", [None], no)
    index = spark.createDataFrame([one(no, no) for no in range(6)], schema)
    asked = spark.createDataFrame([one(no, 100 + no) for no in range(6)], schema)
    found = impact_index._meet(index, asked, 6, 20).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in found} == {(100 + no, no, 1) for no in range(6)}
    assert len({r.task for r in found}) == 6


# --- 5: toxicity ---------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    match = toxicity.Lexicon().matcher()
    hit = lambda t: match(t)[1]
    assert hit("You IDIOT!") == hit("you 1d10t") == hit("уоu іdiоt") == hit("id​iot") == 1
    assert hit("the trash can is full") == 0 and hit("trash talk") == 1
    assert hit("idiotic") == 0 and hit("clownfish and clown fish") == 0
    assert hit("") == hit(None) == 0


def test_toxicity_entries_are_written_nowhere(spark, monkeypatch):
    # clean texts hold "clown" more often than toxic ones, so that seed goes; "moron" only toxic texts hold; "scum" nobody does
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeou") + rng.choice("mnrv") + rng.choice("aeou")
    rows = [(i, " ".join(word() for _ in range(30)) + (" clown" if i % 8 in (0, 1, 4) else "") + (" moron quuxy" if i % 2 else ""), i % 2) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    written, write = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    terms = toxicity.learn(spark, docs, labels).terms
    assert written == ["toxic-sample", "toxic-distinct"]
    assert toxicity.fold("clown") not in terms and terms[toxicity.fold("scum")] == 2.0
    assert "quuxy" in terms and toxicity.fold("moron") in terms


def test_toxicity_learns_stems(spark):
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice("xyz") for _ in range(40))
    rows = [(i, clean() + (f" zorgl{rng.choice(['ak', 'en', 'it', 'ov'])} zorgl{rng.choice(['um', 'ix'])}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(1, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(spark, docs, labels)
    truth = dict((i, y) for i, _, y in rows)
    got = toxicity.score(docs, lexicon).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_edges(spark, odd):
    plain = toxicity.learn(spark, odd.limit(0), table(spark, SF, "labels"))
    rows = toxicity.score(odd, plain).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.3 for r in rows)
    assert toxicity.keep(odd, plain).count() == odd.count()
    assert toxicity.score(odd.limit(0), plain).collect() == []


# --- 6: shards -----------------------------------------------------------------------------------------------


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump(spark):
    keys = [*range(500), -1, 2**63 - 1, -(2**63), 10**15 + 7, None]
    for n in (1, 2, 16, 100):
        got = jump_shards.with_jump(spark.createDataFrame([(k,) for k in keys], "k long"), "k", n).collect()
        assert all((r.shard, r.grown) == (jump(r.k or 0, n), jump(r.k or 0, n + 1)) for r in got)


def test_shards(spark, odd):
    rows = jump_shards.shard_rows(odd).collect()
    assert len(rows) == odd.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    text = dict(enumerate(ODD))
    for r in rows:
        raw = (text[r.doc_id] or "").encode() if r.doc_id is not None else ODD[4].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
    assert jump_shards.shard_rows(odd.limit(0)).collect() == []


# --- 7: tokens -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    path = prefix_bpe.model_path()
    return prefix_bpe.PrefixBpe(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_tokens_equal_the_library(models):
    own, library = models
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "ß", "12", "日", "한", "\U0001f600", "\U0001f9ff", "\x00", "́", "<s>", "<0x41>", "<unk>", "�", "​", "ing", ".", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [" " * n + "w" * (n % 3) + " " * (n % 19) for n in range(80)] + ["a" * 5000, " " * 5000, "日本" * 3000] + [t or "" for t in ODD[:6]]
    texts += [f"a{x}b\n{x}c\n\n{x} d{x}e \n{x}\n" for x in parts] + [f"{x}one\ntwo{x}" for x in parts]
    digests = own.results(texts)
    assert own.results(texts) == digests  # from memory
    for text, (count, ids, ids_hash, text_hash) in zip(texts, digests, strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want))
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want)
        assert count == len(want) and ids_hash == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert text_hash == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_pair_tests_equal_plain_merging(models):
    own = models[0]
    rng = random.Random(6)
    tokens = list(own._reachable.values())
    short = [t for t in tokens if len(own.pieces[t]) <= 4]
    same = [t for t in tokens if len(set(own.pieces[t])) == 1]
    for pool in (tokens, short, same, [t for t in same if own.pieces[t][0] == prefix_bpe.SPACE]):
        for _ in range(4000):
            a, b = rng.choice(pool), rng.choice(pool)
            x, y = own.pieces[a], own.pieces[b]
            assert own._stays(a, b) == (own.merge(x + y) == [x, y]), (x, y)


def test_small_memories_are_refilled(models, monkeypatch):
    for name in ("WORDS", "PAIRS", "STEPS", "COLUMNS"):
        monkeypatch.setattr(prefix_bpe, name, 7)
    monkeypatch.setattr(prefix_bpe, "SLOTS", 1 << 10)
    own, library = prefix_bpe.PrefixBpe(prefix_bpe.model_path()), models[1]
    texts = [f"word{i % 11} and\nline{i % 5}  two  é{i}" for i in range(60)] + ["plain words only\nhere"] * 3
    for _ in range(3):
        assert [r[1] for t in texts for r in own.results([t])] == [",".join(map(str, library.encode(t))) for t in texts]


def test_long_texts_are_cut_between_words(models, monkeypatch):
    own, library = models
    monkeypatch.setattr(prefix_bpe, "PIECE", 50)
    text = "some  words   and\nlines of a   text " * 20
    want = library.encode(text)
    assert own.encode(text) == want
    assert own.results([text, "b", text])[0][0] == len(want)


def test_tokens_query(spark, odd, models):
    rows = prefix_bpe.encode_decode(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert prefix_bpe.encode_decode(odd.limit(0)).collect() == []
    ids = {r.doc_id: r.ids for r in prefix_bpe.token_ids(odd).collect()}
    assert ids[5] == models[1].encode(ODD[5])


# --- 8: mixing -----------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by resharing the excess until none is above."""
    weight = {s: weights[i % 3] for i, s in enumerate(sizes)}
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["b", "a", "ä", "z", None, "a", "a"])) for i in range(1500)]
    rows += [(5000, None, "q"), (5001, "", None), rows[0], rows[0], (None, "null id words", "a")]
    docs = spark.createDataFrame([(*r, 3.0, 8) for r in rows], "doc_id long, text string, source string, target double, shard int")
    got = mixture_tree.taken(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water({s: sizes[s] for s in order})
    source = {i: s for i, _, s in rows}
    near = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r["size"] == 0 or r.taken % r["size"] == 0 and r.taken <= 2 * r["size"]
        near[s] += r.taken
    assert all(abs(near[s] - want[s]) <= 60 for s in order)
    assert all((r.taken == r['size'] * ((r.first_shard is not None) + (r.second_shard is not None))) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixture_tree.taken(docs.repartition(7)).collect()))
    again = mixture_tree.mixed(docs)
    assert again.schema == docs.schema and sum(len((r.text or "").split()) for r in again.collect()) == sum(near.values())
    assert mixture_tree.taken(docs.limit(0)).collect() == [] and mixture_tree.mixed(docs.limit(0)).collect() == []


def test_mix_shuffles_in_shards_and_keeps_clashing_columns(spark):
    rows = [(i, f"w{i} " * (i % 9), f"s{i % 3}", i, "a", "b", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix int, mix_row string, _mix_copies string, copy string")
    got = mixture_tree.mixed(docs, with_places=True).collect()
    assert {(r[0], r[3], r[4], r[5], r[6]) for r in got} <= {(r[0], r[3], r[4], r[5], r[6]) for r in rows}
    want = Counter()
    for r in mixture_tree.taken(docs).collect():
        want[r.doc_id] += r.taken // max(r["size"], 1)
    assert +Counter(r.doc_id for r in got) == +want
    by_shard = {}
    for r in got:
        by_shard.setdefault(r[-1].shard, []).append((r[-1].key, r.doc_id))
    assert len(by_shard) > 8 and all(len(set(k)) == len(k) for k in by_shard.values())
    assert any([d for _, d in sorted(k)] != sorted(d for _, d in k) for k in by_shard.values())


def test_rows_alike_are_drawn_one_by_one(spark, monkeypatch):
    """A source that is one repeated document comes near its target too."""
    monkeypatch.setattr(mixture_tree, "ALIKE", 7)
    rows = [(1, "w " * 100, "a")] * 200 + [(i, "x y " * (i % 40), "b") for i in range(100, 400)] + [(2, "once more", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture_tree.taken(docs).collect()
    total = Counter()
    for r in got:
        total[r.doc_id in (1, 2) and r.doc_id] += r.taken
    goal = next(r.target for r in got if r.doc_id == 1)
    assert abs(total[1] - goal) <= 100 and len(got) == len(rows)
    assert sum(r.doc_id == 1 for r in mixture_tree.mixed(docs).collect()) == total[1] // 100


def test_tree_keeps_quotas_and_leaves_draw_disjoint_blocks(spark):
    quotas = spark.createDataFrame([(False, "a", 40), (False, "b", 21), (True, "", 3)], "no_source boolean, source string, quota long")
    leaves = mixture_tree.split(quotas, 5)
    rows = leaves.collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {"a": 40, "b": 21, "": 3} and set(by_shard) == set(range(5))
    assert max(by_shard.values()) - min(by_shard.values()) <= 2
    drawn = mixture_tree.draw(leaves).collect()
    assert Counter((r.source, r.shard) for r in drawn) == {(r.source, r.shard): r.quota for r in rows}
    assert sorted((r.source, r.block) for r in drawn) == sorted((s, b) for s, n in by_source.items() for b in range(n))
    for shard in range(5):
        assert sorted(r.place for r in drawn if r.shard == shard) == list(range(by_shard[shard]))
    other = mixture_tree.draw(mixture_tree.split(quotas, 5, seed=7), seed=7).collect()
    assert {(r.source, r.block, r.shard) for r in other} != {(r.source, r.block, r.shard) for r in drawn}
    less = mixture_tree.draw(leaves.withColumn("quota", F.when(F.col("shard") == 0, 1).otherwise(F.col("quota")).cast("long"))).count()
    assert less < len(drawn)  # what leaves don't draw isn't in the mix


def test_mixing_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    key = lambda r: str(r)
    got = sorted(map(tuple, mixture_tree.taken(table(spark, SF, "documents")).collect()), key=key)
    assert got == sorted(connection.sql(mixture_tree.SQL).fetchall(), key=key)


# --- 9: SimHash ----------------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(prints):
    parts = {p: p for p in prints}

    def root(p):
        while parts[p] != p:
            p = parts[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            parts[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_every_close_pair_shares_a_mask():
    first, second = covering_simhash.masks()
    for spot in itertools.combinations(range(64), 3):
        difference = sum(1 << b for b in spot)
        under = [k for k, m in enumerate(first) if not m & difference]
        assert under and all(any(not m & difference for m in second[k]) for k in under)


def test_prints(spark, odd):
    for text in ODD[:6] + ["A b\x0bC d", "É é É é"]:
        assert covering_simhash.fingerprint(text) == brute_print(text)
    assert covering_simhash.fingerprint(LONG[:30_000]) == brute_print(LONG[:30_000])
    rows = covering_simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert {r.component_id for r in rows if r.doc_id is None} == {4}
    assert covering_simhash.near_duplicates(odd.limit(0)).collect() == []
    kept = covering_simhash.keep(odd)
    assert kept.schema == odd.schema and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 6, 7]


def test_one_row_of_each_group_stays(spark):
    """Ids that are missing or repeated don't tie unrelated texts together; near copies still go."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d, e, f = (" ".join(rng.choices(words, k=300)) for _ in range(6))
    near = d.upper() + "  "  # the same fingerprint, another text
    rows = [(None, a), (None, b), (None, b), (None, c), (None, near), (1, d), (5, d), (5, e), (5, f), (5, f), (7, None), (7, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = covering_simhash.keep(docs)
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert kept.schema == docs.schema
    assert got == Counter([(None, a), (None, b), (None, c), (1, d), (5, e), (5, f), (7, "")])


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_connect_all_close_prints(spark, bucket):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in list(prints)[:20]:
        now = base
        for _ in range(25):  # chains and clouds around some prints
            for _ in range(rng.randint(1, 4)):
                now ^= 1 << rng.randrange(64)
            prints.add(now)
            now = base if rng.random() < 0.5 else now
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    found = covering_simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), bucket=bucket).collect()
    parts = brute_parts(sorted(prints))
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in found:
        a, b = r.src % 2**64, r.dst % 2**64
        assert parts[a] == parts[b]
        parent[root(a)] = root(b)
    assert len({root(p) for p in prints}) == len(set(parts.values()))


# --- 10: languages -------------------------------------------------------------------------------------------


def test_languages(spark, odd):
    docs = table(spark, SF, "documents")
    model = langmix.learn(docs)
    rows = langmix.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    edge = {r.doc_id: r for r in langmix.identify(odd, model).collect()}
    assert all(edge[i].lang_pred == "und" and edge[i].score == 0 for i in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in edge.values())
    nothing = langmix.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langmix.identify(odd, nothing).collect()} == {"und"}
    assert langmix.identify(odd.limit(0), model).collect() == []


def test_mixture_of_two_languages(spark):
    docs = table(spark, SF, "documents")
    model = langmix.learn(docs)
    long = {r.lang: r.text for r in docs.where("n_chars > 3000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    text = long["en"][:1500] + " " + long["de"][:1500]
    both = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {r.lang: r["share"] for r in langmix.proportions(both, model).collect()}
    assert set(found) == {"en", "de"} and 0.3 < found["en"] < 0.7 and abs(sum(found.values()) - 1) < 1e-6


# --- the pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = __import__("graphloom.session", fromlist=["x"]).materialize(stage(spark, docs, SF), "stage")
        assert out.schema.names == docs.schema.names
        seen[name] = out.count()
        docs = out
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == seen["mixing sources"] and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in final.collect()} == kept
    assert seen["toxicity"] <= 200 and seen["quality classifier"] <= seen["toxicity"] and seen["SimHash near-dedup"] <= seen["quality classifier"]
    prints = [brute_print(r.text) for r in docs.select("doc_id", "text").distinct().collect()]
    assert all((a ^ b).bit_count() > 3 for a, b in itertools.combinations(prints, 2))
