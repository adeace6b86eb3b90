"""Extraction on single texts, and the domain rules and sinks that have no SQL."""

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom import sinks
from graphloom.extraction import craft, frames, payloads, relation_rules, sentences, statements
from graphloom.functions import domain
from graphloom.sources import registers


def kinds(text):
    return [(m.kind, m.identifier) for m in craft.find(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("IMO 9074729 sails, IMO 9074728 doesn't.", [("imo_number", "9074729")]),
        ("Seen: 9H-ABX, RA-12340, VP-CXY and N512QA.", [("aircraft_registration", "9H-ABX"), ("aircraft_registration", "RA-12340"), ("aircraft_registration", "VP-CXY"), ("aircraft_registration", "N512QA")]),
        ("Flight BA417 and SU 4082, but not QQ12, A380 or PT-BR.", [("flight_number", "BA417"), ("flight_number", "SU4082")]),
        ("The superyacht Amber Light left.", [("craft_appositive", "Amber Light")]),
        ("the vessel IMO 9074728 is unknown", []),
        ("MS Windows, MS Enterprise, MT Digital Horizon and SS Enterprise Software", [("vessel_prefixed", "Digital Horizon")]),
        ("A G-LIST, the I-95 and E-COMMERCE", []),
        ("MMSI: 211331640 with a bulk carrier", [("mmsi", "211331640"), ("vessel_type", "bulk carrier")]),
        ("chassis 1HGCM82633A004352 was found", [("vin", "1HGCM82633A004352")]),
        ("B-1234 and G-ABCD", [("aircraft_registration", "B-1234"), ("aircraft_registration", "G-ABCD")]),
        ("", []),
    ],
)
def test_craft(text, want):
    assert kinds(text) == want


def test_overlapping_matches_leave_the_longer():
    rng = random.Random(4)
    for _ in range(300):
        spans = [craft.Match(a := rng.randrange(60), a + rng.randint(1, 15), "k", "", "", "", rng.choice([0.5, 0.9])) for _ in range(rng.randint(0, 9))]
        kept = craft.resolve(spans)
        assert set(kept) <= set(spans) and kept == sorted(kept, key=lambda m: m.start)
        if spans:
            assert max((s.end - s.start) for s in spans) == max((s.end - s.start) for s in kept)
    assert craft.register_country("VP-CXY") == "Cayman Islands" and craft.register_country("9H-X") == "Malta"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Weiss met J. Smith at 3.14 p.m. today. He left!", ["Dr. Weiss met J. Smith at 3.14 p.m. today.", "He left!"]),
        ("Am 3. Oktober 2020 kam sie. Danach ging er.", ["Am 3. Oktober 2020 kam sie.", "Danach ging er."]),
        ("Elle dit : « Bonsoir ! » Puis elle part.", ["Elle dit : « Bonsoir ! »", "Puis elle part."]),
        ("Он пришёл. Она ушла?! Да.", ["Он пришёл.", "Она ушла?!", "Да."]),
        ("他来了。她走了！好。", ["他来了。", "她走了！", "好。"]),
        ("One line\nanother line. and on", ["One line", "another line. and on"]),
        (" \n ", []),
    ],
)
def test_sentences(text, want):
    found = sentences.split(text)
    assert [s.text for s in found] == want and all(text[s.start : s.end] == s.text for s in found)


def test_plain_sentences():
    text = "Acme Ltd. Jane Doe met Mr. Smith. then more. \"Yes.\" No?"
    assert [s.text for s in sentences.split_plain(text)] == ["Acme Ltd.", "Jane Doe met Mr. Smith. then more.", '"Yes."', "No?"]


def test_chunks_cover_the_text_and_fit():
    rng = random.Random(1)
    for _ in range(120):
        text = " ".join(rng.choice(["Short one.", "A somewhat longer sentence with words, and signs!", "x" * rng.randint(1, 400), "日本語。", "Words " * rng.randint(1, 60) + "end."]) for _ in range(rng.randint(1, 25)))
        most, overlap = rng.choice([(8, 0), (40, 12), (64, 63), (384, 64)])
        found = sentences.chunks(text, most, overlap)
        assert all(text[c.start : c.end] == c.text for c in found)
        assert all(c.tokens <= most + 1 for c in found if not c.cut or " " in c.text)
        covered = set().union(*(range(c.start, c.end) for c in found)) if found else set()
        assert {i for i, ch in enumerate(text) if not ch.isspace()} <= covered
        whole = [c for c in found if not c.cut]
        starts = {s.start for s in sentences.split(text)}
        assert all(c.start in starts for c in whole)
    with pytest.raises(ValueError):
        sentences.chunks("x", 10, 10)


def test_statements():
    found = statements.statements("Ivan Petrov reportedly founded Amber Holdings Ltd. Jane Doe, director of Amber Holdings, flew to Malta. Acme Corp is owned by Jane Doe.")
    told = {(s.subject.text, s.verb, s.object.text, s.passive, s.hedged) for s in found}
    assert ("Ivan Petrov", "founded", "Amber Holdings Ltd", False, True) in told
    assert any(s[1] == "director" and s[2].startswith("Amber Holdings") for s in told)
    assert any(s[1] == "is owned by" and s[3] and s[2] == "Jane Doe" for s in told)
    assert statements.statements("") == [] and statements.statements(None) == []
    assert all(s.negated for s in statements.statements("Jane Doe never owned Acme Corp, but Jane Doe owns Beta Corp."))


def test_payloads():
    assert payloads.clean("a ​b\r\n\r\n\r\n\r\nc\x00\td ") == "a b\n\nc d"
    assert payloads.json_lines('{"a": {"b": [1, null, {"c": "x"}]}, "d": ""}') == "a.b[0]: 1\na.b[2].c: x"
    assert payloads.row_lines("a;b\n1;\n;2\n") == "a=1\nb=2"
    cases = [("application/pdf", "", b"", "pdf"), ("", "", b"  %PDF-1", "pdf"), ("application/octet-stream", "x.bin", b"PK\x03\x04", "archive"), ("application/octet-stream", "x", b"<html>", "html"),
             ("", "a.csv", b"[1]", "json"), ("text/csv", "a.pdf", b"", "pdf"), ("text/html", "a.json", b"{", "html"), ("", "", b"plain", "html"), ("", "x/y.unknown", b"plain", "text")]
    for content_type, url, body, want in cases:
        assert payloads.kind_of(content_type, url, body) == want
    assert payloads.extract(b"{", "application/json").warning == "invalid-json"


def test_extraction_over_a_table(spark):
    texts = [(1, "Jane Doe owns Acme Ltd.", 9), (2, None, 9), (3, "", 9), (4, "Acme Ltd never owned Beta Ltd.", 9), (1, "Jane Doe owns Acme Ltd.", 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string, start int")
    said = frames.statements_found(df)
    assert Counter((r.doc_id, r.verb) for r in said.collect())[1, "owns"] == 4
    typed = relation_rules.relations(said.dropDuplicates(["doc_id", "verb"]).withColumn("id", F.monotonically_increasing_id()).withColumn("sentence", F.col("clause")))
    assert {(r.subject, r.predicate, r.object) for r in typed.collect()} == {("Jane Doe", "OWNS", "Acme Ltd")}
    for find in (frames.craft_matches, frames.names_found, frames.sentences_found, frames.chunks_found, frames.cleaned):
        assert find(df.limit(0)).collect() == [] and find(df).columns[0] == "doc_id"


def test_extra_rules_stand_behind_their_priority(spark):
    rows = spark.createDataFrame([(1, "dance", "Person", "Person", "", "", False), (2, "met", "Person", "Person", "", "", False)], "id long, word string, subject_type string, object_type string, sentence string, preposition string, passive boolean")
    extra = (("FAMILY_OF", "dance met", "P", "P", 0.5, 7, False),)
    got = {r.id: (r.predicate, r.evidence) for r in relation_rules.decide(rows, "verb", extra).collect()}
    assert got == {1: ("FAMILY_OF", 0.5), 2: ("MET_WITH", 0.9)}


def test_domain(spark):
    rows = [
        (1, "Amber Holdings (BVI) Ltd", "Organization", {"status": "Dormant", "nominee": "true", "icij_id": "7"}), (2, "Family Trust of Doe", "Organization", {"jurisdiction": "panama"}),
        (3, "Jane Doe", "Person", {"jurisdiction": "panama"}), (4, "Company #12", "Organization", {"reg_number": "1", "country": "Germany", "phone": "1"}), (5, None, "Organization", None), (6, "Ida", "Craft", {"imo": "1", "tail_number": " g abcd "}),
    ]
    df = spark.createDataFrame(rows, "id int, name string, entity_type string, properties map<string, string>")
    n, t, p = F.col("name"), F.col("entity_type"), F.col("properties")
    got = {r.id: r for r in df.select("id", domain.shell_risk(n, t, p).alias("risk"), domain.labels(n, t, p).alias("labels"), domain.gps(F.lit("POINT(12.5 41.9)")).alias("gps"), domain.extras(n, t, p, F.array(F.lit("B"), F.lit("A"))).alias("extras")).collect()}
    assert got[1].risk.score == 1.0 and "placeholder name (redacted vehicle)" not in got[1].risk.reasons and got[1].labels == ["Entity", "Organization", "Company", "ShellCompany", "Offshore"]
    assert got[2].risk.score == 0 and got[2].labels == ["Entity", "Organization", "Foundation", "Offshore"]
    assert got[3].labels == ["Entity", "Person"] and got[4].risk.score == 0.2 and got[5].risk.score == 0.1
    assert got[6].labels == ["Entity", "Craft", "Aircraft"] and got[6].extras["tail_number"] == "G-ABCD" and got[6].gps == "12.500000,41.900000"


def test_sinks(spark):
    packed = sinks.archive([("a/b.txt", "é"), ("..c", "")])
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        assert z.namelist() == ["a_b.txt", "_c"] and z.read("a_b.txt").decode() == "é" and z.testzip() is None
    with pytest.raises(ValueError):
        sinks.archive([("a", ""), ("a", "")])
    text = spark.createDataFrame([("ab\ncd\nefghij\n\nk",), (None,), ("",)], "t string")
    got = [r.m for r in text.select(sinks.messages(F.col("t"), 5).alias("m")).collect()]
    assert got[0] == ["ab\ncd", "efghi", "j\n\nk"] and got[1] == got[2] == []
    nodes = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError):
        sinks.publish(nodes.limit(0), spark.createDataFrame([], "source string, target string"), "file:///tmp/never-written")


def test_registers(spark):
    raw = spark.createDataFrame([("123AB", "REGISTRANT: JOHN  MCKAY", "1 Main St", "US"), ("", "X", "", ""), ("9h-abx", " ", "", ""), ("G-ABCD", "Blue Sky Aviation LLC", "1 Main Street", "UK")], "n_number string, name string, street string, country string")
    got = registers.aircraft_register(raw).orderBy("tail").collect()
    assert [(r.tail, r.owner, r.owner_type) for r in got] == [("G-ABCD", "Blue Sky Aviation LLC", "Organization"), ("N123AB", "John McKay", "Person")]
    crowd = spark.createDataFrame([("k", f"P{i:03}", "Person", "k street") for i in range(41)] + [("m", f"Q{i}", "Person", "m") for i in range(8)] + [("s", "alone", "Person", "s")], "address_key string, owner string, owner_type string, address string")
    edges = Counter(r.predicate for r in registers.shared_addresses(crowd).collect())
    assert edges == {"LOCATED_IN": 24, "SHARES_ADDRESS": 24}
    aboard = spark.createDataFrame([("l", "c", f"p{i:02}") for i in range(15)] * 2, "log string, craft string, person string")
    assert registers.travelled_together(aboard).count() == 60


def test_statements_by_shape():
    """Texts that differ in digits alone share their shape, unless the digits tell what is found."""
    from graphloom.extraction import craft as detector

    texts = ["Unit 12 Ltd owns Unit 34 Ltd.", "Unit 34 Ltd owns Unit 34 Ltd.", "Unit 1 Ltd owns Unit 1 Ltd Holdings.", "Boeing 737 Holdings owns Acme Ltd.", "Boeing 738 Holdings owns Acme Ltd.", "N12AB Trading sold to É7 Ltd."]
    for text in texts * 2:
        assert statements.statements(text) == statements.told(text, statements.names(text), statements.matches(text))
    assert [bool(detector.find(t)) for t in texts[3:5]] == [True, False] and all(detector.possible(t) for t in texts[3:5])
    assert not any(detector.possible(t) for t in texts[:3])


def test_relations_of_statements_with_one_id(spark):
    """Each statement is decided by its own verb, and none of them is shuffled for it."""
    df = spark.createDataFrame([(1, "Jane Doe owns Acme Ltd. Ivan Petrov met Jane Doe. Jane Doe owns Acme Ltd.")], "doc_id long, text string")
    said = frames.statements_found(df, once=True).withColumn("id", F.col("doc_id")).withColumn("sentence", F.col("clause"))
    typed = relation_rules.relations(said)
    assert sorted((r.subject, r.predicate, r.object) for r in typed.collect()) == [("Ivan Petrov", "MET_WITH", "Jane Doe"), ("Jane Doe", "OWNS", "Acme Ltd")]
    assert "hashpartitioning(id" not in typed._jdf.queryExecution().executedPlan().toString()
