"""Checks of proposed claims: each reason, short forms, and the whole query against plain Python."""

import re

from pyspark.sql import functions as F

from graphloom.extraction import claims
from graphloom.plans import claims as plans

SCHEMA = (
    "text string, subject string, subject_type string, predicate string, object string, object_type string, evidence string, negated boolean, hedged boolean, "
    "confidence double, source_weight double, others array<struct<name: string, entity_type: string>>"
)
TEXT = "Mira Toldan owns “Velkor Shipping GmbH” outright. Toldan's stake was said to be large. She allegedly sold it. OWNS nothing more, Velkor Shipping and Toldan said."


def row(evidence, predicate="OWNS", subject="Mira Toldan", object_="Velkor Shipping GmbH", negated=False, confidence=1.0, others=(), object_type="Organization"):
    return (TEXT, subject, "Person", predicate, object_, object_type, evidence, negated, None, confidence, 0.8, list(others))


def test_reasons(spark):
    whole = 'Mira Toldan owns "Velkor  Shipping GmbH"'
    cases = [
        (row(whole), None),
        (row(whole, "LIKES"), "predicate"),
        (row(whole, None), "predicate"),
        (row(whole, negated=True), "negated_or_hedged"),
        (row("She allegedly sold it."), "negated_or_hedged"),
        (row("Mira Toldan owns Velkor"), "evidence_not_verbatim"),
        (row("Mira"), "evidence_not_verbatim"),
        (row(None), "evidence_not_verbatim"),
        (row("OWNS nothing more"), "injection_marker"),
        (row(whole, object_="Nobody Ltd"), "unresolved_entity"),
        (row(whole, object_type=None), "unresolved_entity"),
        (row(whole, object_="mira toldan"), "unresolved_entity"),
        (row("Shipping GmbH” outright"), "evidence_missing_subject"),
        (row("Toldan's stake was said"), "evidence_missing_object"),
        (row("Velkor Shipping and Toldan said"), None),
        (row("Velkor Shipping and Toldan said", others=[("Anna Toldan", "Person")]), "evidence_missing_subject"),
        (row("Velkor Shipping and Toldan said", others=[("Anna Toldan", "Organization"), (None, "Person")]), None),
    ]
    got = claims.validate(spark.createDataFrame([c for c, _ in cases], SCHEMA), ["OWNS", "CONTROLS"])
    rows = got.select("reason", "confidence_checked").collect()
    assert [r.reason for r in rows] == [reason for _, reason in cases]
    assert rows[0].confidence_checked == 0.48 and rows[1].confidence_checked is None
    odd = claims.validate(spark.createDataFrame([row(whole, confidence=None), row(whole, confidence=7.0)], SCHEMA), ["OWNS"])
    assert [r.confidence_checked for r in odd.collect()] == [0.36, 0.36]
    assert {r.reason: r.claims for r in claims.reasons(got).collect()}["accepted"] == 3
    assert claims.validate(spark.createDataFrame([], SCHEMA), ["OWNS"]).collect() == []


def test_short_forms(spark):
    names = [("mira toldan-vey", "Person", "vey"), ("mira", "Person", ""), ("velkor gmbh & co. kg", "Organization", "velkor"), ("abc ag", "Organization", ""), ("velkor", "Location", ""), (None, "Person", "")]
    made = spark.createDataFrame(names, "name string, kind string, want string").select("want", claims.short_form(F.col("name"), F.col("kind")).alias("got"))
    assert all(r.want == r.got for r in made.collect())


def test_query_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    doubt = re.compile(claims.DOUBTS, re.I)
    marker = re.compile(r"\b(?:" + "|".join(plans.PREDICATES) + r")\b|(?i:" + claims.INJECTED + ")")
    fold = lambda s: re.sub(r"\s+", " ", (s or "").translate(str.maketrans(claims.DOUBLE + claims.SINGLE + claims.DASHES, '"' * 7 + "'" * 8 + "-" * 7, claims.SOFT_HYPHEN)).replace("…", "...")).strip().lower()
    want = {}
    for c in plans._claims(spark, d).collect():
        quote, text, subject, object_ = fold(c.evidence), fold(c.text), fold(c.subject), fold(c.object)
        legal = re.sub(claims.LEGAL_FORMS, "", subject).strip(" ,")
        parts = [p for p in re.split(r"[\s\-]+", subject) if len(p) >= 3]
        short = (parts[-1] if len(parts) >= 2 else "") if c.subject_type == "Person" else (legal if legal != subject and len(legal) >= 4 else "")
        other = fold(c.others[0].name)
        tail = [p for p in re.split(r"[\s\-]+", other) if len(p) >= 3]
        shared = c.subject_type == "Person" and other != subject and ((len(tail) >= 2 and tail[-1] == short) or other.startswith(short + " "))
        has = bool(subject) and subject in quote or bool(short) and not shared and re.search(r"(?<!\w)" + re.escape(short) + r"(?:s|'s|')?(?!\w)", quote) is not None
        want[c.doc_id] = (
            "predicate" if c.predicate not in plans.PREDICATES
            else "negated_or_hedged" if c.negated or doubt.search(c.evidence)
            else "evidence_not_verbatim" if not 8 <= len(c.evidence.strip()) <= 400 or quote not in text
            else "injection_marker" if marker.search(c.evidence)
            else "unresolved_entity" if not (2 <= len(subject) <= 120 and 2 <= len(object_) <= 120 and c.object_type and subject in text and object_ in text) or subject == object_
            else "evidence_missing_subject" if not has
            else "evidence_missing_object" if object_ not in quote
            else None
        )
    got = {r.doc_id: r.reason for r in plans.x27_validated_claims(spark, d).collect()}
    assert got == want and len(set(want.values())) > 3


def test_grounded(spark):
    made = [(1, 2, "Mira owns Velkor.", "Mira", "Owner_of", "Velkor"), (1, 1, "Mira owns Velkor.", "mira", "owns", "velkor"), (1, 3, "Mira owns Velkor.", "Mira", "owns", "Anna"),
            (2, 1, "A b", "A", "likes", "b"), (2, 2, "A b", "A", "owns", "a"), (2, 3, "A b", None, "owns", "b"), (3, 1, None, "x", "owns", "y")]
    frame = spark.createDataFrame(made, "chunk_id int, position int, chunk string, subject string, predicate string, object string")
    keep = lambda most: sorted((r.chunk_id, r.position, r.predicate) for r in claims.grounded(frame, plans.ALIASES, most).collect())
    assert keep(20) == [(1, 1, "OWNS"), (1, 2, "OWNS")] and keep(1) == [(1, 1, "OWNS")]
