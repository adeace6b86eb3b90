"""Parts of the training-data operators against plain loops, their defined cases, and the pipeline against a brute-force version."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import (
    common,
    covering_simhash,
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
from graphloom.session import materialize

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000
CLASH = "doc_id long, text string, source string, lang string, _none int, _key int, none int, key int, digest int, mix int, _mix_copy int, score int, shard int, n int, row int, size int, fp int, y int, _top int"


def clash(rows):
    """Rows (doc_id, text, source) with columns called as the operators' own ones."""
    return [(*r, "en", *range(15)) for r in rows]


ROWS = [
    (0, None, "a"), (1, "", None), (2, " \n\t ", "a"), (3, "one", "b"), (4, "Ünïcode wörds ß 日本語 \U0001f600 end", None), (5, LONG, "b"),
    (6, "same text here and a few more words", "a"), (7, "same text here and a few more words", "a"), (7, "same text here and a few more words", "a"),
    (None, "no id but quite some text all the same", "b"), (None, "no id and another text than the row before", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(clash(ROWS), CLASH)


# --- shared ---------------------------------------------------------------------------------------------------


def test_join_spread_equals_a_plain_left_join(spark):
    rows = [(i, 1 if i % 3 == 0 else (None if i % 7 == 0 else i % 50)) for i in range(2000)]
    left = spark.createDataFrame(rows, "id long, key long")
    side = spark.createDataFrame([(k, k * 10, sum(x == k for _, x in rows)) for k in range(0, 40)], "key long, value long, n long")
    want = Counter((i, k, k * 10 if k is not None and k < 40 else None) for i, k in rows)
    for hot in (1, 5, 1000):
        assert Counter(tuple(r) for r in common.join_spread(left, side, "key", "n", hot).collect()) == want
    text = common.join_spread(left.withColumn("key", F.col("key").cast("string")), side.withColumn("key", F.col("key").cast("string")), "key", "n", 2)
    assert Counter((r.id, r.value) for r in text.collect()) == Counter((i, v) for i, _, v in want.elements())


# --- 1: quality -----------------------------------------------------------------------------------------------


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality_gbdt.FEATURES)
    n, words = len(raw), raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda members: sum(b in members for b in raw) / n
    other = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "#*$%&<>!.?,;:|"}
    out = {"log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / len(words) if words else 0}
    out |= {"upper": share(range(65, 91)), "digit": share(range(48, 58)), "space": share(b" \t"), "newline": share(b"\n"), "symbol": share(b"#*$%&<>"), "bang": share(b"!")}
    out |= {"stop_mark": share(b".?"), "comma": share(b",;:"), "pipe": share(b"|"), "other_mark": share(other), "wide": share(range(128, 256))}
    out["byte_entropy"] = -sum(c / n * math.log2(c / n) for c in Counter(raw).values())
    ranked = sorted(Counter(words).values(), reverse=True)
    out |= {"distinct_words": len(ranked) / len(words) if words else 0, "top_word": ranked[0] / len(words) if words else 0, "top_ten_words": sum(ranked[:10]) / len(words) if words else 0}
    out["distinct_pairs"] = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if words else 0
    out |= {"distinct_lines": len(set(lines)) / len(lines) if lines else 0, "line_length": math.log1p(n / len(lines)) if lines else 0}
    out |= {"long_words": sum(len(w) > 12 for w in words) / len(words) if words else 0, "short_words": sum(len(w) < 3 for w in words) / len(words) if words else 0}
    packer = zlib.compressobj(1)
    out["deflated"] = (len(packer.compress(raw)) + len(packer.flush())) / n
    return [out[f] for f in quality_gbdt.FEATURES]


def test_statistics_equal_plain_counts(spark):
    texts = [t for _, t, _ in ROWS] + [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    for text in texts:
        assert np.allclose(quality_gbdt.statistics(text), plain_statistics(text), atol=1e-12)


def test_boosting_fits_what_one_cut_explains():
    x = np.linspace(0, 1, 400)[:, None]
    y = (x[:, 0] > 0.6).astype(float)
    forest = quality_gbdt.fit(x, y, trees=30, depth=1)
    p = forest.predict(x)
    assert (p[x[:, 0] > 0.63] > 0.9).all() and (p[x[:, 0] < 0.57] < 0.1).all()
    first = forest.cut[0][0]
    assert 0.55 < first < 0.65 and (forest.feature == 0).all()
    # the first leaf values are one Newton step from the base
    base = 1 / (1 + math.exp(-forest.base))
    side = x[:, 0] > first
    want = [-0.15 * (base - y[s]).sum() / (s.sum() * base * (1 - base) + 2.0) for s in (~side, side)]
    assert np.allclose(forest.leaf[0], want)


# --- 2: repetition --------------------------------------------------------------------------------------------


def plain_cover(text):
    words = (text or "").encode().split()
    sizes = [len(w.decode()) for w in words]
    out = {}
    for n in repetition.LENGTHS:
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(n)}
        out[f"covered_{n}"] = sum(sizes[i] for i in inside)
        out["n_repeat_words"] = len(inside) if n == 5 else out["n_repeat_words"]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    times = Counter(lines)
    out["covered_lines"] = sum(len(w.decode()) for x in lines if times[x] > 1 for w in x.encode().split())
    symbols, chars = sum(c in "#*$%&|<>" for c in text or ""), sum(sizes)
    base = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    shares = any(out[f"covered_{n}"] > most * chars for n, most in repetition.LENGTHS.items()) or out["covered_lines"] > repetition.MAX_LINE_SHARE * chars
    return out | {"base_failed": base, "kept": not (base or shares or symbols > repetition.MAX_SYMBOLS_A_WORD * len(words))}, shares


def test_coverage_and_verdict_equal_plain_counts(spark):
    rng = random.Random(7)
    texts = [t for _, t, _ in ROWS[:5]] + ["\n".join(rng.choice(["a b c d é", "x y z", "q" * rng.randint(1, 30), f"u{rng.random()} v"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    long = " ".join(f"w{i}" for i in range(100))
    texts += [long + " " + "verylongrepeatedword" * 3 + " a b c d " + long[:0] + "tail " + ("verylongrepeatedword" * 30 + " ") * 14]
    texts += [long + "\n" + "k" * 400 + "\n" + "k" * 400]  # few words repeat, most characters do
    verdicts = Counter()
    for text in texts:
        want, shares = plain_cover(text)
        got = repetition.measure(text)
        assert {k: got[k] for k in want} == want
        verdicts[want["base_failed"], shares, want["kept"]] += 1
    assert verdicts[False, True, False] and verdicts[False, False, True] and verdicts[True, False, False]


# --- 3: WARC --------------------------------------------------------------------------------------------------


def test_revisits_resolve_to_record_ids(spark, tmp_path):
    big, h = "ß<p>" * 400_000, "x" * 150
    rows = [(1, None, h), (2, None, h), (3, "u", big), (4, None, big), (5, "a", "y" * 120), (5, "b", "y" * 120), (5, "a", "y" * 120), (6, None, "y" * 120), (None, None, "q" * 101), (None, "z", "q" * 101), (8, "s", None)]
    pages = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "page_id long, url string, html string, role int, digest string, n int")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, most=1 << 20)
    records = warc.read_records(spark, path, with_payload=True).collect()
    ids = [r.record_id for r in records]
    assert len(ids) == len(set(ids)) == 3 * len(rows)
    answers = {r.record_id: r for r in records if r.record_type == "response"}
    for r in records:
        if r.record_type == "revisit":
            assert answers[r.refers_to].payload_digest == r.payload_digest
        elif r.record_type != "response":
            assert r.concurrent_to in set(ids)
    assert sum(r.record_type == "revisit" for r in records) == 5 and max(len(r.payload) for r in answers.values()) == len(big.encode())
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    lowest = {}
    for page, _, html in rows:
        if page is not None:
            lowest[html] = min(page, lowest.get(html, page))
    want, done = Counter(), set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and html in lowest and html in done
        done.add(html)
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", lowest[html] if again else None] += 1
    assert got == want
    size = [f.stat().st_size for f in tmp_path.joinpath("w").glob("part*")]
    assert all(s <= (1 << 20) + 8 or s > len(big.encode()) for s in size)


def test_broken_archives_are_noticed(spark):
    part = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, page_id long"
    schema = f"capture_id string, page_id long, request struct<{part}>, response struct<{part}>, metadata struct<{part}>"
    answer = lambda kind, refers, size: ("i", kind, None, refers, "d", size, None, None)
    note = ("m", "metadata", None, None, None, 5, None, 1)
    for response in (answer("revisit", "gone", None), answer("response", None, 4)):
        with pytest.raises(Exception, match="no record|another length"):
            warc.resolve(spark.createDataFrame([("c", 1, None, response, note)], schema)).collect()


# --- 5: toxicity ----------------------------------------------------------------------------------------------


def plain_match(lexicon, text):
    folded = toxicity.fold(text)
    bodies = {}
    for term, weight in lexicon.terms.items():
        body = term.rstrip("*")
        stem, known = bodies.get(body, (False, -math.inf))
        bodies[body] = (stem or term.endswith("*"), max(weight, known))
    spans = lambda body: (i for i in range(len(folded)) if folded.startswith(body, i) and not (i and folded[i - 1].isalpha()))
    ends = lambda body, i: i + len(body) == len(folded) or not folded[i + len(body)].isalpha()
    spared = [(i, i + len(p)) for p in map(toxicity.fold, toxicity.EXCEPTIONS) if p not in bodies for i in spans(p) if ends(p, i)]
    best = {}
    for body, (stem, weight) in bodies.items():
        for i in spans(body):
            if (stem or ends(body, i)) and not any(a <= i and i + len(body) <= b for a, b in spared) and (i not in best or weight > best[i][1]):
                best[i] = (body, weight)
    weights = [w for _, w in best.values()]
    return sum(weights), len({b for b, _ in best.values()}), max(weights, default=0.0), len(folded.split())


def test_matching_equals_a_plain_search():
    rng = random.Random(11)
    lexicon = toxicity.Lexicon({toxicity.fold(k): v for k, v in {"trash": 2.0, "idiot": 1.5, "id": 0.5, "clown*": 1.25, "clown fish": 3.0, "scum": 1.0, "scum*": 0.75}.items()})
    parts = ["trash", "can", "trash can", "1d10t", "idiot", "іdiоt", "clown", "clownfish", "clown fish", "scum line", "scummy", "scum", "id", "x", " ", " ", " ", "-", "TRASH", "tra​sh", "$cum", "\n"]
    match = lexicon.matcher()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got, want = match(text), plain_match(lexicon, text)
        assert got[1:] == want[1:] and math.isclose(got[0], want[0], abs_tol=1e-9), text


# --- 6: shards ------------------------------------------------------------------------------------------------


def test_repeated_rows_get_gapless_slots(spark):
    rows = [(1, "hot")] * 500 + [(i, f"t{i}") for i in range(200)] + [(None, "a"), (None, "b"), (None, "a")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, jump int, shard int, n int")
    for shards in (1, 16, 5000):
        got = jump_shards.shard_rows(docs, shards).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        for shard, own in itertools.groupby(sorted((r.shard, r.slot) for r in got), key=lambda x: x[0]):
            assert [s for _, s in own] == list(range(sum(r.shard == shard for r in got)))
    assert jump_shards.with_jump(docs.withColumn("_jump", F.lit(1)), "doc_id", 4).count() == len(rows)


# --- 10: languages --------------------------------------------------------------------------------------------


def plain_infer(model, grams):
    names, buckets = range(len(model.names)), range(len(grams))

    def em(allowed):
        shares = [1 / len(allowed) if i in allowed else 0.0 for i in names]
        for _ in range(0 if len(allowed) == 1 else langmix.ITERATIONS):
            mixed = [sum(shares[i] * model.rates[i][b] for i in names) for b in buckets]
            shares = [shares[i] * sum(grams[b] / mixed[b] * model.rates[i][b] for b in buckets) / sum(grams) for i in names]
            shares = [s / sum(shares) for s in shares]
        return shares, sum(g * math.log(sum(shares[i] * model.rates[i][b] for i in names)) for b, g in enumerate(grams))

    allowed = set(names)
    shares, fit = em(allowed)
    while len(allowed) > 1:
        least = min(allowed, key=lambda i: (shares[i], i))
        trial = em(allowed - {least})
        if not trial[1] > fit - langmix.PENALTY * math.log(sum(grams) + 2):
            break
        allowed, (shares, fit) = allowed - {least}, trial
    return shares, fit


def test_inference_equals_plain_loops():
    rng = np.random.default_rng(5)
    rates = rng.dirichlet(np.full(24, 0.3), 4) + 1e-4
    model = langmix.Languages(list("abcd"), rates / rates.sum(1, keepdims=True))
    mixes = [[1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.3, 0.3, 0.4, 0], [0, 0, 0, 1], [0.9, 0, 0.1, 0]] * 4
    grams = np.stack([rng.multinomial(n, np.array(m) @ model.rates / (np.array(m) @ model.rates).sum()) for m, n in zip(mixes, itertools.cycle([3, 40, 600]))]).astype(float)
    shares, fit = model.infer(grams)
    for row, got, value in zip(grams, shares, fit):
        want, goal = plain_infer(model, row.tolist())
        assert np.allclose(got, want, atol=1e-8) and abs(value - goal) < 1e-6


def plain_counts(text):
    raw = (" " + langmix._OTHER.sub(" ", text.lower()).strip() + " ").encode()
    out = Counter()
    for n in langmix.LENGTHS:
        for i in range(len(raw) - n + 1):
            rolled = 0
            for b in raw[i : i + n]:
                rolled = (rolled * 257 + b) % 2**32
            out[(rolled + n) * 2654435761 % 2**32 >> 20] += 1
    return out


@pytest.mark.parametrize("stretch", [1, 2, 5, 17, 1 << 20])
def test_long_texts_count_as_one(monkeypatch, stretch):
    monkeypatch.setattr(langmix, "STRETCH", stretch)
    rng = random.Random(3)
    parts = ["a", "ß", "Σ", "ΟΔΟΣ", "'", " ", "  ", "\n", "12", "日本", "é", "word", "İ", "."]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) + "z"
        found = langmix.counts(text)
        assert {i: int(c) for i, c in enumerate(found) if c} == dict(plain_counts(text)), text


def test_every_language_is_learnt(spark):
    rows = [(i * 4 + k, f"{chr(97 + k)}{chr(97 + i % 26)} " * 20, f"l{i}") for i in range(230) for k in range(3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "null id", "l0", 1), (5, None, "l1", 1), (6, "", "l2", 1)], "doc_id long, text string, lang string, chance int")
    model = langmix.learn(docs)
    assert len(model.names) > 200
    again = langmix.learn(docs.repartition(5))
    assert again.names == model.names and (again.rates == model.rates).all()


# --- stages ---------------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_defined_rows(spark, odd):
    labels = table(spark, SF, "labels")
    lexicon = toxicity.learn(spark, odd, labels)
    forest = quality_gbdt.train(spark, table(spark, SF, "documents"), labels)
    good = [i for i, (_, t, _) in enumerate(ROWS) if forest.predict(np.stack([quality_gbdt.statistics(t)]))[0] >= 0.3]
    stages = {
        "toxicity": (lambda d: toxicity.keep(d, lexicon), [(i, t) for i, t, _ in ROWS]),
        "quality": (lambda d: quality_gbdt.keep(d, forest), [ROWS[i][:2] for i in good]),
        "simhash": (covering_simhash.keep, [(0, None), (3, "one"), *[ROWS[i][:2] for i in (4, 5, 6, 9, 10)]]),
    }
    for name, (stage, want) in stages.items():
        out = stage(odd)
        assert out.schema.names == odd.schema.names, name
        rows = out.collect()
        assert Counter((r[0], r[1]) for r in rows) == Counter(want), name
        assert all(tuple(r[3:]) == ("en", *range(15)) for r in rows), name
        assert stage(odd.limit(0)).collect() == [], name
    mix = mixture_tree.mixed(odd)
    assert mix.schema.names == odd.schema.names and {(r[0], r[1]) for r in mix.collect()} <= {(i, t) for i, t, _ in ROWS if t and t.split()}
    assert mixture_tree.mixed(odd.limit(0)).collect() == []


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    table(spark, SF, "labels").write.parquet(f"{tmp_path}/sf/labels.parquet")
    for rows in (odd, odd.limit(0)):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/sf/documents.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/sf").collect()
        library = sentencepiece.SentencePieceProcessor(model_file=prefix_bpe.model_path())
        texts = {i: t for i, t, _ in ROWS}
        assert all(r.ids == library.encode(texts[r.doc_id]) for r in got if r.doc_id is not None)
    assert got == []


def test_pipeline_equals_a_brute_force_version(spark, tmp_path):
    import corpus_pipeline
    from test_llm import brute_parts, brute_print

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [r.asDict() for r in docs.collect()]
    scores = toxicity.learn(spark, docs, labels).scorer()
    rows = [r for r in rows if scores([r["text"]])[0] < 0.3]
    step = spark.createDataFrame(rows, docs.schema)
    forest = quality_gbdt.train(spark, step, labels)
    rows = [r for r in rows if forest.predict(np.stack([plain_statistics(r["text"])]))[0] >= 0.3]
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows}
    parts = brute_parts(sorted(set(prints.values())))
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(parts[prints[r["doc_id"]]], r["doc_id"])
    rows = [r for r in rows if first[parts[prints[r["doc_id"]]]] == r["doc_id"]]
    connection = duckdb.connect()
    path, _ = materialize(spark.createDataFrame(rows, docs.schema), "brute")
    path.toPandas().to_parquet(f"{tmp_path}/d.parquet")
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    copies = {i: n for i, n in connection.sql(f"SELECT doc_id, taken // size FROM ({mixture_tree.SQL}) WHERE size > 0").fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=prefix_bpe.model_path())
    want = Counter()
    for r in rows:
        if copies.get(r["doc_id"]):
            ids = library.encode(r["text"])
            want[r["doc_id"], len(ids), tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += copies[r["doc_id"]]
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 50
