"""Checks of relations that a model proposes for a document: closed predicates, quotes word by word, names in the quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quotes and dashes that models replace when they quote; a soft hyphen is dropped.
DOUBLE, SINGLE, DASHES, SOFT_HYPHEN = "„“”‟«»″", "‚‘’‛‹›´`", "‐‑‒–—―−", "­"

#: Legal forms at the end of a name that texts leave out.
LEGAL_FORMS = (
    r"(?:[\s,]+(?:&\s*co\.?|gmbh|ag|se|kgaa|kg|ohg|ug|e\.\s?v\.|mbh|ltd\.?|limited|inc\.?|corp\.?|corporation|"
    r"llc|plc|s\.\s?a\.?|sa|s\.p\.a\.?|spa|n\.\s?v\.?|nv|b\.\s?v\.?|bv|ab|a/s|oyj?|sarl|holding))+\.?$"
)

#: Words that deny a statement or put it in doubt.
DOUBTS = (
    r"\b(nicht|nie|niemals|weder|kein\w*|angeblich\w*|möglicherweise|mutmaßlich\w*|vermutlich|offenbar|"
    r"wohl|soll|sollen|sollte|sollten|könnte|könnten|dürfte|dürften|dementi\w*|bestreit\w*|bestritt\w*|"
    r"abgestritten|leugn\w*|geleugnet|zurückgewiesen|zurückweis\w*|vorgeworfen|vorwurf\w*|vorwürfe\w*|"
    r"beschuldig\w*|verdacht\w*|verdächtig\w*|gerücht\w*|spekul\w*|"
    r"(?-i:not)|never|neither|no longer|alleg\w*|reportedly|purportedly|supposedly|denie[sd]|deny|denying|denial|"
    r"disput\w*|accus\w*|suspect\w*|might|could|rumou?r\w*|speculat\w*)\b"
)

#: Phrases that address the model rather than the reader.
INJECTED = r"\b(?:system|assistant|developer)\s*:|\bignorier\w*\b|\bignore\s+(?:all|any|the|previous|prior)\b|\b(?:instructions?|anweisung\w*|prompt)\b"

#: The factor of a model's relations, the length of a quote in characters.
MODEL_FACTOR, QUOTE = 0.6, (8, 400)


def folded(text: Column) -> Column:
    """Lower case, single spaces, plain quotes and dashes."""
    plain = F.translate(text, DOUBLE + SINGLE + DASHES + SOFT_HYPHEN, '"' * len(DOUBLE) + "'" * len(SINGLE) + "-" * len(DASHES))
    return F.lower(F.trim(F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), r"(?U)\s+", " ")))


def short_form(name: Column, entity_type: Column) -> Column:
    """A person's surname, an organisation's name without its legal form, or an empty text. ``name`` is folded."""
    parts = F.filter(F.split(name, r"(?U)[\s\-]+"), lambda p: F.length(p) >= 3)
    core = F.regexp_replace(F.regexp_replace(name, "(?U)" + LEGAL_FORMS, ""), "^[ ,]+|[ ,]+$", "")
    surname = F.when(F.size(parts) >= 2, F.element_at(parts, -1))
    bare = F.when((core != name) & (F.length(core) >= 4), core)
    return F.coalesce(F.when(entity_type == "Person", surname).when(entity_type == "Organization", bare), F.lit(""))


def named_in(name: Column, entity_type: Column, quote: Column, others: Column) -> Column:
    """Whether a folded quote has the whole name, or a short form that no other entity of the document shares.

    ``others`` is an array of (name, entity_type) of the document, names as written.
    """
    full = folded(F.coalesce(name, F.lit("")))
    short = short_form(full, entity_type)

    def shares(o: Column) -> Column:
        other = folded(o["name"])
        return (other != full) & (o["entity_type"] == entity_type) & ((short_form(other, entity_type) == short) | other.startswith(F.concat(short, F.lit(" "))))

    shared = F.coalesce(F.exists(others, shares), F.lit(False))
    word = F.concat(F.lit(r"(?U)(?<!\w)\Q"), short, F.lit(r"\E(?:s|'s|')?(?!\w)"))
    return F.coalesce(((full != "") & F.contains(quote, full)) | ((short != "") & ~shared & F.regexp_like(quote, word)), F.lit(False))


def validate(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """Add ``reason`` (null where a claim holds) and ``confidence_checked`` (null where it doesn't).

    ``claims`` has text, subject, subject_type, predicate, object, object_type, evidence, negated, hedged, confidence,
    source_weight and others (see ``named_in``). The first check that fails gives the reason. An entity is resolved where
    its type is known and its name is in the text; a confidence that is missing or outside 0..1 counts as a half.
    Null texts and quotes are empty ones.
    """
    evidence = F.trim(F.coalesce("evidence", F.lit("")))
    text, quote = folded(F.coalesce("text", F.lit(""))), folded(evidence)
    resolved = lambda c: F.coalesce(F.col(f"{c}_type").isNotNull() & F.length(folded(F.col(c))).between(2, 120) & F.contains(text, folded(F.col(c))), F.lit(False))
    same = folded(F.col("subject")) == folded(F.col("object"))
    flagged = F.coalesce(F.col("negated"), F.lit(False)) | F.coalesce(F.col("hedged"), F.lit(False))
    marker = r"(?U)\b(?:" + "|".join(predicates) + rf")\b|(?i:{INJECTED})"
    reason = (
        F.when(~F.coalesce(F.col("predicate").isin(predicates), F.lit(False)), "predicate")
        .when(flagged | evidence.rlike("(?iuU)" + DOUBTS), "negated_or_hedged")
        .when(~F.length(evidence).between(*QUOTE) | ~F.contains(text, quote), "evidence_not_verbatim")
        .when(evidence.rlike(marker), "injection_marker")
        .when(~resolved("subject") | ~resolved("object") | same, "unresolved_entity")
        .when(~named_in(F.col("subject"), F.col("subject_type"), quote, F.col("others")), "evidence_missing_subject")
        .when(~named_in(F.col("object"), F.col("object_type"), quote, F.col("others")), "evidence_missing_object")
    )
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.lit(0.5))
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("source_weight")))
    checked = claims.withColumn("reason", reason)
    return checked.withColumn("confidence_checked", F.when(F.col("reason").isNull(), F.round(weight * MODEL_FACTOR * (0.5 + 0.5 * sure), 6)))


def reasons(checked: DataFrame) -> DataFrame:
    """(reason, claims): how many claims held (``accepted``) or failed each check."""
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("claims"))


def grounded(triplets: DataFrame, aliases: dict[str, str], most: int = 20) -> DataFrame:
    """Triplets of a chunk whose subject and object are in it, under their documented predicate; the first ``most`` a chunk.

    ``triplets`` has chunk_id, position, chunk, subject, predicate, object. Equal ends and unknown predicates are dropped.
    """
    from pyspark.sql import Window as W

    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    predicate = F.element_at(names, F.lower(F.trim(F.regexp_replace("predicate", r"[\s_\-]+", " "))))
    chunk = folded(F.col("chunk"))
    inside = lambda c: (F.length(F.trim(c)) > 0) & F.contains(chunk, folded(F.col(c)))
    kept = triplets.withColumn("predicate", predicate).where(F.col("predicate").isNotNull() & inside("subject") & inside("object") & (folded(F.col("subject")) != folded(F.col("object"))))
    place = F.row_number().over(W.partitionBy("chunk_id").orderBy("position"))
    return kept.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
