"""Small rules that many operators share: labels, dates, limits, searches, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import names, similarity, vocab

#: Labels of models and the types of entities they stand for.
LABEL_TYPES = {
    "PERSON": "Person", "PER": "Person", "ORG": "Organization", "ORGANIZATION": "Organization", "LOC": "Location", "LOCATION": "Location", "GPE": "Location", "FAC": "Location",
    "CRAFT": "Craft", "VEHICLE": "Craft", "AIRCRAFT": "Craft", "VESSEL": "Craft", "PRODUCT": "Craft",
}
#: The documented labels, and other spellings of each.
DOCUMENTED = "Person Organization Location Date Vehicle Aircraft_Registration IMO_Number Bank_Account Crypto_Address".split()
SPELLINGS = {
    "Person": "person|people|per|human", "Organization": "organization|organisation|org|company|institution", "Location": "location|loc|gpe|place|address", "Date": "date|dates|time",
    "Vehicle": "vehicle|craft|vessel|ship|aircraft", "Aircraft_Registration": "aircraft_registration|aircraft_registrations|aircraft registration|tail_number|tail number|registration",
    "IMO_Number": "imo_number|imo number|imo", "Bank_Account": "bank_account|bank account|iban|account_number|account number",
    "Crypto_Address": "crypto_address|crypto address|cryptocurrency_address|wallet|wallet_address|bitcoin_address|blockchain_address",
}
#: Endings that make a name without a type one of an organisation.
_ORG_TAIL = (
    "(?:\\b(?:GmbH|AG|SE|KGaA|KG|OHG|UG|mbH|Ltd|Limited|Inc|Corp|Corporation|LLC|PLC|plc|S\\.A|SA|S\\.p\\.A|SpA|N\\.V|NV|B\\.V|BV|A/S|Oyj|SARL|e\\.\\s?V)\\.?|"
    "(?:Holding|Stiftung|Bank|Konzern|Gruppe|Group))$"
)
#: Months of freshness that may be asked for; hours in which an alert is suppressed.
FRESH_WINDOWS, QUIET_HOURS = (6, 12, 24, 60), 24
#: Scores at which names match by their signs, or by their tokens.
MATCH, REORDERED, SIMILAR = 0.88, 0.35, 0.60


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def label_type(label: Column) -> Column:
    """The type of entity that a model's label stands for."""
    return F.coalesce(_lookup(LABEL_TYPES, F.upper(label)), F.lit("Unknown"))


def documented_label(value: Column) -> Column:
    """One of the documented labels for any of its spellings, else null."""
    folded = F.lower(F.trim(F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("-"), F.lit("_")), "\\s+", " ")))
    return _lookup({s: k for k, v in SPELLINGS.items() for s in v.split("|")}, folded)


def name_type(label: Column, text: Column) -> Column:
    """The type of a short label; a name of no type with an organisation's ending is one; else null."""
    known = _lookup({"PER": "Person", "PERSON": "Person", "ORG": "Organization", "LOC": "Location", "GPE": "Location"}, label)
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), "[,;:!?]+$", "")
    return F.coalesce(known, F.when((label == "MISC") & plain.rlike(_ORG_TAIL), "Organization"))


def type_of_labels(labels: Column) -> Column:
    """The type among a node's labels."""
    kinds = F.array(*map(F.lit, ("Person", "Organization", "Location", "Craft")))
    return F.coalesce(F.get(F.filter(kinds, lambda k: F.array_contains(labels, k)), F.lit(0)), F.lit("Unknown"))


def match(left: Column, right: Column) -> Column:
    """The struct (score, signal) of two names: by their signs first, else by their tokens where the signs aren't against it."""
    a, b = names.fold(left), names.fold(right)
    string = F.when(a == b, 1.0).otherwise(F.greatest(similarity.jaro_winkler(a, b), similarity.levenshtein_ratio(a, b)))
    token = similarity.token_similarity(names.tokens(left, vocab.LEGAL_TOKENS), names.tokens(right, vocab.LEGAL_TOKENS))
    by_token = ((token >= 1.0) & (string >= REORDERED)) | ((token >= MATCH) & (string >= SIMILAR))
    tokens = (string < MATCH) & by_token
    return F.struct(F.when(tokens, F.greatest(string, token)).otherwise(string).alias("score"), F.when(tokens, "token").otherwise("string").alias("signal"))


def fuzzy_date(text: Column, now: Column) -> Column:
    """A day, month or year inside a text as a date between 1900 and a year from now; else null."""
    day, month, year = (F.regexp_extract(F.coalesce(text, F.lit("")), p, 0) for p in ("\\b\\d{4}-\\d{2}-\\d{2}\\b", "\\b\\d{4}-\\d{2}\\b", "\\b\\d{4}\\b"))
    found = F.coalesce(F.try_to_date(day), F.try_to_date(F.concat(F.nullif(month, F.lit("")), F.lit("-01"))), F.try_to_date(F.concat(F.nullif(year, F.lit("")), F.lit("-01-01"))))
    return F.when((found >= F.lit("1900-01-01").cast("date")) & (found <= F.add_months(now, 12)), found)


def month_or_year(text: Column) -> Column:
    """``YYYY-MM`` or ``YYYY`` at the start of a text, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "^(\\d{4}(?:-(?:0[1-9]|1[0-2]))?)", 1), F.lit(""))


def fresh_window(months: Column) -> Column:
    return F.coalesce(months.isin(*FRESH_WINDOWS), F.lit(False))


def prefix_query(text: Column, most: int = 6) -> Column:
    """A search text as prefixes: its first words of two signs or more, joined by OR."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(w, F.lit("*"))), " OR ")


def matches_prefixes(text: Column, query: Column) -> Column:
    """Whether a text has a word that begins with one of the prefixes of ``prefix_query``."""
    some = F.split(F.replace(query, F.lit("*"), F.lit("")), " OR ")
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return (query != "") & F.exists(words, lambda w: F.exists(some, lambda p: F.startswith(w, p)))


def suppressed(last_sent: Column, now: Column) -> Column:
    """Whether an alert went out less than a day ago."""
    return F.coalesce(F.timestamp_diff("SECOND", last_sent, now) < QUIET_HOURS * 3600, F.lit(False))


def model_json(text: Column, schema: str) -> Column:
    """The records in a model's answer: the first array in it, behind whatever was said or fenced around it."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)(\\[.*\\])", 1)
    return F.from_json(F.nullif(body, F.lit("")), f"array<{schema}>")
