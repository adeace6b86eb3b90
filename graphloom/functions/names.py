"""Names: folding, keys, tokens and types, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import vocab

_EMPTY = "array<string>"


def _accent_table() -> tuple[str, str]:
    """Latin letters and the base letter that compatibility decomposition leaves of them."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), "\\p{Mn}", "")


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def fold(text: Column) -> Column:
    """Accents, case, typographic signs and decoration folded; & and @ spelt out."""
    out = strip_accents(F.coalesce(text, F.lit("")))
    out = F.translate(out, "“”„‟‘’‚‛‹›«»–—−‑      ", "\"\"\"\"''''''\"\"----      ")
    out = F.replace(F.replace(F.replace(out, F.lit("​"), F.lit("")), F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, "[\"'`()\\[\\]{}]", ""), "\\s+", " ")))


def tokens(text: Column, drop: list[str] | None = None) -> Column:
    """Alphanumeric tokens of the folded name, without those in ``drop`` unless nothing is left."""
    raw = F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")
    if not drop:
        return raw
    kept = F.filter(raw, lambda t: ~F.array_contains(_words(drop), t))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def normalize(name: Column, entity_type: Column) -> Column:
    """Comparison form: legal forms are dropped from organisations, titles from persons."""
    plain = F.replace(F.replace(strip_accents(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    # lower-case tokens between single spaces, so that runs at either end can be cut by one pattern
    spaced = F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, "[\"'“”‘’«»`]", "")), "[\\s,;.\\-_/\\\\|]+", " "))
    tail = "( \\(?(" + "|".join(vocab.ORG_SUFFIXES) + ")\\)?)+$"
    head = "^((" + "|".join(vocab.HONORIFICS) + ")( |$))+"
    generation = "^(\\S+ \\S+.*?)( (" + "|".join(vocab.GENERATIONS) + "))+$"
    cut = (
        F.when(entity_type == "Organization", F.regexp_replace(spaced, tail, ""))
        .when(entity_type == "Person", F.regexp_replace(F.regexp_replace(spaced, head, ""), generation, "$1"))
        .otherwise(spaced)
    )
    return F.trim(F.regexp_replace(cut, "[^a-z0-9]+", " "))


def has_org_marker(name: Column) -> Column:
    words = F.split(normalize(name, F.lit("Unknown")), " ")
    found = F.arrays_overlap(words, _words(vocab.ORG_SUFFIXES + vocab.ORG_MARKERS))
    return (normalize(name, F.lit("Unknown")) != "") & (found | ((F.size(words) > 1) & F.array_contains(_words(vocab.CLUB_PREFIXES), F.element_at(words, 1))))


def canonical_key(name: Column, entity_type: Column) -> Column:
    """TYPE:slug-hash; the slug is cut at 48 characters, the hash is of type and full name."""
    folded = normalize(name, entity_type)
    slug = F.rtrim(F.translate(F.substring(folded, 1, 48), " ", "-"), F.lit("-"))
    digest = F.substring(F.sha1(F.concat(entity_type, F.lit("|"), folded)), 1, 8)
    return F.concat(F.upper(entity_type), F.lit(":"), F.when(slug == "", "unknown").otherwise(slug), F.lit("-"), digest)


def name_key(name: Column) -> Column:
    """Resolution form: umlauts transliterated before folding, trailing legal forms dropped."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    for sign, letters in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "o", "å": "aa"}.items():
        lower = F.replace(lower, F.lit(sign), F.lit(letters))
    plain = F.replace(strip_accents(lower), F.lit("&"), F.lit(" und "))
    spaced = F.trim(F.regexp_replace(plain, "[^0-9a-z\\u0370-\\u03ff\\u0400-\\u04ff\\u0600-\\u06ff\\u4e00-\\u9fff]+", " "))
    return F.trim(F.regexp_replace(spaced, "(^| )(" + "|".join(vocab.LEGAL_TOKENS) + ")( (" + "|".join(vocab.LEGAL_TOKENS) + "))*$", ""))


def phonetic_key(name: Column) -> Column:
    """One letter and three digits over the whole folded name; names in other scripts keep eight characters."""
    letters = F.regexp_replace(name_key(name), "[^\\p{L}\\p{N}]", "")
    code = F.translate(letters, "".join(vocab.SOUNDEX), "".join(d * len(k) for k, d in vocab.SOUNDEX.items()))
    # h and w let equal codes meet, vowels keep them apart
    joined = F.regexp_replace(F.regexp_replace(code, "(?<=.)[hw]", ""), "([1-6])\\1+", "$1")
    first = F.substring(letters, 1, 1)
    own = F.translate(first, "".join(vocab.SOUNDEX), "".join(d * len(k) for k, d in vocab.SOUNDEX.items()))
    digits = F.regexp_replace(F.when(F.substring(joined, 1, 1) == own, F.substring(joined, 2, 1 << 20)).otherwise(joined), "[^1-6]", "")
    latin = F.concat(F.upper(first), F.rpad(F.substring(digits, 1, 3), 3, "0"))
    return F.when(letters == "", "").when(first.rlike("^[a-z]$"), latin).otherwise(F.concat(F.lit("u:"), F.substring(letters, 1, 8)))


def block_keys(name: Column, entity_type: Column, generic: list[str] | None = None) -> Column:
    """Keys of the blocks in which a name is compared: first letters, initials, sorted tokens."""
    kind = F.lower(F.coalesce(entity_type, F.lit("unknown")))
    words = tokens(name, generic)
    some = F.array(
        F.concat(F.lit("t:"), kind, F.lit(":"), F.substring(fold(name), 1, 3)),
        F.concat(F.lit("s:"), kind, F.lit(":"), F.array_join(F.array_sort(F.transform(words, lambda t: F.substring(t, 1, 1))), "")),
        F.concat(F.lit("n:"), kind, F.lit(":"), F.array_join(F.array_sort(words), "|")),
    )
    return F.when(fold(name) == "", F.array().cast(_EMPTY)).when(F.size(words) == 0, F.slice(some, 1, 1)).otherwise(some)


def natural_order(name: Column) -> Column:
    """``SURNAME, Forename`` as it is spoken."""
    return F.regexp_replace(name, "^([^,]+),\\s*(.+)$", "$2 $1")
