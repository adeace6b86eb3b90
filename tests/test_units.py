"""Hand-made cases of expressions, graph measures, merging, resolution and sources."""

import datetime as dt
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.functions import confidence, craft, dates, hashing, names, similarity
from graphloom.operators import graph, provenance, resolve, upsert
from graphloom.operators.components import connected_components
from graphloom.sources import files
from graphloom.sources.html import main_text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "name, kind, want",
    [("Acme Holding GmbH", "Organization", "acme"), ("Dr. José  Pérez, Jr.", "Person", "jose perez"), ("Müller & Söhne", "Unknown", "muller and sohne"), ("", "Person", ""), (None, "Person", ""), ("GmbH", "Organization", "gmbh")],
)
def test_normalize(spark, name, kind, want):
    assert one(spark, names.normalize(F.lit(name).cast("string"), F.lit(kind))) == want


def test_name_key(spark):
    assert one(spark, names.name_key(F.lit("Müller & Söhne GmbH"))) == "mueller und soehne"
    assert one(spark, names.name_key(F.lit("Schmidt GmbH & Co KG"))) == "schmidt"


@pytest.mark.parametrize("name, want", [("Robert", "R163"), ("Rupert", "R163"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("", "")])
def test_phonetic_key(spark, name, want):
    assert one(spark, names.phonetic_key(F.lit(name))) == want


def test_similarity():
    assert round(similarity.jaro_of("martha", "marhta"), 4) == 0.9444
    assert round(similarity.winkler_of("martha", "marhta"), 4) == 0.9611
    assert round(similarity.winkler_of("dixon", "dicksonx"), 4) == 0.8133
    assert similarity.jaro_of("", "a") == 0 == similarity.jaro_of(None, "a")
    assert similarity.token_similarity_of(["petrov", "ivan"], ["ivan", "petrov"]) == 1


def test_confidence(spark):
    assert one(spark, confidence.noisy_or(F.lit(0.5), F.lit(0.5))) == 0.75
    assert one(spark, confidence.compose(F.lit(0.4), F.lit("cooccurrence"), F.lit(1.0))) == 0.32
    assert one(spark, confidence.clamp01(F.lit(float("nan")))) == 0
    docs = F.array(F.lit("a"), F.lit("b"))
    assert not one(spark, confidence.corroboration_is_new(docs, F.lit("a")))
    assert one(spark, confidence.corroboration_is_new(docs, F.lit("")))
    assert one(spark, confidence.remember_doc(docs, F.lit("c"), 2)) == ["b", "c"]


def test_hashes(spark):
    assert one(spark, hashing.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, hashing.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, hashing.cycle_id(F.array(F.lit("b"), F.lit("a")))) == one(spark, hashing.cycle_id(F.array(F.lit("a"), F.lit("b"))))


def test_craft(spark):
    assert one(spark, craft.imo_valid(F.lit("9074729")))
    assert not one(spark, craft.imo_valid(F.lit("9074728")))
    assert one(spark, craft.looks_like_tail(F.lit("D-ABCD"))) and one(spark, craft.looks_like_tail(F.lit("N123AB")))
    assert one(spark, craft.normalize_tail(F.lit("n-123ab"))) == "N123AB"


def test_dates(spark):
    assert one(spark, dates.parse_timestamp(F.lit("Tue, 3 Mar 2020 10:00:00 GMT"))) == dt.datetime(2020, 3, 3, 10)
    assert one(spark, dates.parse_timestamp(F.lit("nonsense"))) is None
    assert one(spark, dates.months_before(F.lit("2020-03-31").cast("date"), 1)) == dt.date(2020, 2, 29)


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, w double")


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)]
    found = connected_components(edges_of(spark, *chain, ("x", "y"), ("z", "z")))
    groups = {r.component: r["count"] for r in found.groupBy("component").count().collect()}
    assert groups == {"n000": 121, "x": 2, "z": 1}
    assert connected_components(edges_of(spark, ("a", "b")).limit(0)).isEmpty()


def test_betweenness(spark):
    path = {r.node: r.betweenness for r in graph.betweenness(edges_of(spark, ("a", "b"), ("b", "c"))).collect()}
    assert path == {"a": 0, "b": 1, "c": 0}
    clique = edges_of(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    assert all(r.betweenness == 0 for r in graph.betweenness(clique).collect())


def test_articulation(spark):
    cut = lambda *e: sorted(r.node for r in graph.articulation_points(edges_of(spark, *e)).collect())
    assert cut(("a", "b"), ("b", "c")) == ["b"]
    assert cut(("a", "b"), ("b", "c"), ("a", "c")) == []
    barbell = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    assert cut(*barbell) == ["c", "d"]


def test_strong_components(spark):
    found = {r.node: r.component for r in graph.strong_components(edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"))).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_core_and_labels(spark):
    e = edges_of(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"))
    assert sorted(r.node for r in graph.core(e, 2).collect()) == list("abcdef")
    labels = {r.node: r.label for r in graph.label_propagation(e).collect()}
    assert len({labels[n] for n in "ab"}) == 1 and len(labels) == 6


def test_upsert_twice_is_once(spark):
    row = "subject string, predicate string, object string, confidence double, observations long, weight double, docs array<string>"
    stored = spark.createDataFrame([("a", "OWNS", "b", 0.5, 1, 1.0, ["d1"])], row)
    new = spark.createDataFrame([("a", "OWNS", "b", 0.5, 1, 1.0, ["d2"]), ("a", "OWNS", "c", 0.4, 1, 1.0, ["d2"])], row)
    once = upsert.upsert_edges(stored, new)
    twice = upsert.upsert_edges(once, new)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.object: r.confidence for r in once.collect()} == {"b": 0.75, "c": 0.4}


def test_conflicts(spark):
    day = lambda s: dt.date.fromisoformat(s) if s else None
    rows = [("a", "OWNS", "b", "2020-01-10"), ("b", "SOLD", "a", "2021-06-01"), ("c", "OWNS", "d", "2023-02-01"), ("c", "OWNS", "d", "2023-04-01"), ("d", "DISPUTED", "c", "2023-03-01"), ("a", "OWNS", "e", "2020-01-01"), ("a", "MET", "e", None)]
    seen = spark.createDataFrame([(s, p, o, day(t), str(i)) for i, (s, p, o, t) in enumerate(rows)], "subject string, predicate string, object string, seen date, doc_id string")
    assert {(r.a, r.b): r.status for r in provenance.conflicts(seen).collect()} == {("a", "b"): "sequence", ("c", "d"): "conflict", ("a", "e"): "undated"}


def test_resolution(spark):
    rows = spark.createDataFrame(
        [("k1", "Brelandia Overseas Ltd", "organization", 5, 0.9), ("k2", "Brelandia Oversea Ltd", "organization", 2, 0.9), ("k3", "Other Firm", "organization", 9, 0.9)],
        "key string, name string, entity_type string, mentions long, confidence double",
    )
    accepted = resolve.decide(resolve.score_pairs(resolve.blocked_pairs(rows), rows))
    assert {(r.key, r.winner) for r in resolve.classes(accepted, rows).collect()} == {("k1", "k1"), ("k2", "k1")}


def test_identifiers(spark):
    kind = "struct<lei: string, imo: string>"
    pair = spark.createDataFrame([(("x", "1"), ("x", "2")), (("x", "1"), ("y", "1")), ((None, "1"), ("", "1"))], f"l {kind}, r {kind}")
    shared, conflict = resolve.shared_identifier("l", "r", ("lei", "imo"))
    assert [tuple(r) for r in pair.select(shared, conflict).collect()] == [("lei", False), (None, True), ("imo", False)]


def test_delimited_and_archives(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tail No.;Owner Name\nN1;Acme\nN2;\n")
    found = files.read_delimited(spark, f"file://{tmp_path}/a.csv", {"owner": ["missing", "owner_name"]}).collect()
    assert [(r.tail_no, r.owner) for r in found] == [("N1", "Acme"), ("N2", None)]
    with gzip.open(tmp_path / "b.txt.gz", "wt") as out:
        out.write("one\ntwo\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as out:
        out.writestr("in.csv", "x,y\n")
        out.writestr("skip.bin", "no")
    lines = files.archive_members(spark, f"file://{tmp_path}/*.[gz][zi][p]*").collect() + files.archive_members(spark, f"file://{tmp_path}/b.txt.gz").collect()
    assert ("b.txt", 1, "two") in {(r.member, r.line_no, r.line) for r in lines}


def test_payload_kind(spark):
    assert one(spark, files.payload_kind(F.lit("application/pdf"), F.lit("x"), F.lit(""))) == "pdf"
    assert one(spark, files.payload_kind(F.lit(""), F.lit("http://a/b.csv?x"), F.lit(""))) == "csv"
    assert one(spark, files.payload_kind(F.lit(""), F.lit("http://a/b"), F.lit("<!DOCTYPE html>"))) == "html"


def test_html():
    page = main_text('<html lang="en"><head><title>T</title><script>var x="</p>"</script></head><body><nav>menu</nav><div class="ad">buy</div><article><p>A sentence that is long enough to stay.</p></article></body></html>')
    assert page == {"title": "T", "lang": "en", "text": "A sentence that is long enough to stay."}
    assert main_text(None)["text"] == ""


def test_protected_pairs_see_every_line(spark, tmp_path):
    """Any shared order protects a pair, whatever the quantity of its lines."""
    from graphloom.plans.support import g36_protected_pairs

    spark.createDataFrame([(k, 1, 250.0) for k in (1, 2, 3, 4)] + [(5, 2, 250.0)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(10, 1, 50.0), (10, 2, 50.0), (11, 1, 3.0), (11, 3, 3.0), (12, 2, 50.0), (12, 4, 48.0), (13, 3, 1.0), (13, 5, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in g36_protected_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 4), (2, 3), (3, 4)}


def test_matching_goes_on_until_no_pair_is_left(spark, monkeypatch):
    from graphloom.operators import resolve
    from graphloom.plans.merging import w03_mutual_best

    pairs = [("A", "B", 0.99, 0.99, 0.99), ("B", "C", 0.98, 0.98, 0.98), ("C", "D", 0.95, 0.95, 0.95), ("E", "F", 0.5, 0.5, 0.5)]
    scored = spark.createDataFrame(pairs, "a string, b string, jaro_winkler double, levenshtein double, score double")
    monkeypatch.setattr(resolve, "score_pairs", lambda *_: scored)
    got = {tuple(r) for r in w03_mutual_best(spark, "/root/testdata/sf0.001").collect()}
    assert got == {("A", "B", 0.99), ("C", "D", 0.95)}


def test_pairs_in_blocks(spark, monkeypatch):
    """Every block is paired whole, however large; a bound that is given holds, and cells lose or repeat no pair."""
    members = [(f"k{i:03}", "large", "") for i in range(500)] + [("x", "small", "P"), ("y", "small", "O"), ("z", "small", ""), ("alone", "one", "")]
    rows = spark.createDataFrame(members, "key string, block string, entity_type string")
    for cell in (1000, 70):
        monkeypatch.setattr(resolve, "CELL", cell)
        pairs = resolve.pairs_in_blocks(rows)
        assert pairs.count() == pairs.distinct().count() == 500 * 499 // 2 + 2
    assert {(r.a, r.b) for r in resolve.pairs_in_blocks(rows, 400).collect()} == {("x", "z"), ("y", "z")}
