"""Queries over scalar and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import confidence, craft, dates, hashing, names, similarity, text, vocab
from graphloom.plans.registry import query
from graphloom.sources.relational import table

_TAILS = ["", " GmbH", " & Co KG", " Ltd.", " Ünïon AG", ", Inc.", " Müller Söhne", " Holdings plc"]
_LIST = "[" + ", ".join(f"'{t}'" for t in _TAILS) + "]"
#: Organisation names of many shapes: the parts' names with legal forms and accents behind them.
NAMES_SQL = f"names AS (SELECT p_partkey AS id, 'The ' || p_name || {_LIST}[p_partkey % 8 + 1] AS name FROM part)"
_SUFFIX = "( \\(?(" + "|".join(vocab.ORG_SUFFIXES) + ")\\)?)+$"
_LEGAL = "|".join(vocab.LEGAL_TOKENS)
_PLAIN = "replace(replace(strip_accents(name), '&', ' and '), '@', ' at ')"
_FOLD = f"lower(trim(regexp_replace(regexp_replace({_PLAIN}, '[\"''`()\\[\\]{{}}]', '', 'g'), '\\s+', ' ', 'g')))"
_SPACED = "trim(regexp_replace(lower({}), '[\\s,;.\\-_/\\\\|]+', ' ', 'g'))".format(_PLAIN)
_NORMAL = f"trim(regexp_replace(regexp_replace({_SPACED}, '{_SUFFIX}', ''), '[^a-z0-9]+', ' ', 'g'))"
_KEY = (
    "trim(regexp_replace(trim(regexp_replace(replace(strip_accents(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '&', ' und '),"
    f" '[^0-9a-z]+', ' ', 'g')), '(^| )({_LEGAL})( ({_LEGAL}))*$', ''))"
)


def _names(spark, d):
    tails = F.array(*map(F.lit, _TAILS))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("The "), F.col("p_name"), F.element_at(tails, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("name")
    )


@query(f"WITH {NAMES_SQL} SELECT id, {_NORMAL} AS normalized FROM names")
def f01_normalize_name(spark, d):
    return _names(spark, d).select("id", names.normalize(F.col("name"), F.lit("Organization")).alias("normalized"))


@query(
    f"WITH {NAMES_SQL}, f AS (SELECT id, {_NORMAL} AS folded FROM names) SELECT id, 'ORGANIZATION:' || rtrim(replace(substring(folded, 1, 48), ' ', '-'), '-') || '-' "
    "|| substring(sha1('Organization|' || folded), 1, 8) AS canonical_key FROM f"
)
def f02_canonical_key(spark, d):
    return _names(spark, d).select("id", names.canonical_key(F.col("name"), F.lit("Organization")).alias("canonical_key"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents")
def f03_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT page_id, 'web:' || substring(sha256('web|' || coalesce(url, '')), 1, 20) AS document_id FROM pages")
def f04_document_id(spark, d):
    return table(spark, d, "pages").select("page_id", hashing.document_id(F.lit("web"), F.col("url")).alias("document_id"))


@query(
    f"WITH {NAMES_SQL}, t AS (SELECT id, string_split(trim(regexp_replace({_SPACED}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM names) SELECT id, "
    + "len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in sorted({*vocab.ORG_SUFFIXES, *vocab.ORG_MARKERS})) + "])) > 0 OR (len(w) > 1 AND list_contains(["
    + ", ".join(f"'{x}'" for x in vocab.CLUB_PREFIXES) + "], w[1])) AS is_organisation FROM t"
)
def f05_org_marker(spark, d):
    return _names(spark, d).select("id", names.has_org_marker(F.col("name")).alias("is_organisation"))


@query(f"WITH {NAMES_SQL} SELECT id, {_FOLD} AS folded FROM names")
def f06_fold_name(spark, d):
    return _names(spark, d).select("id", names.fold(F.col("name")).alias("folded"))


_GENERIC = ["the", "holdings", "gmbh", "ltd", "inc", "co", "kg", "ag", "plc", "and"]
_GENERIC_SQL = "[" + ", ".join(f"'{g}'" for g in _GENERIC) + "]"
_RAW = f"list_filter(regexp_split_to_array({_FOLD}, '[^a-z0-9]+'), lambda t: t <> '')"


@query(
    f"WITH {NAMES_SQL}, r AS (SELECT id, {_RAW} AS raw FROM names), k AS (SELECT id, raw, list_filter(raw, lambda t: NOT list_contains({_GENERIC_SQL}, t)) AS kept FROM r) "
    "SELECT id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE raw END, ' ') AS tokens FROM k"
)
def f07_name_tokens(spark, d):
    return _names(spark, d).select("id", F.array_join(names.tokens(F.col("name"), _GENERIC), " ").alias("tokens"))


@query(f"WITH {NAMES_SQL}, r AS (SELECT id, {_RAW} AS raw FROM names) SELECT id, len(list_filter(raw, lambda t: NOT list_contains({_GENERIC_SQL}, t))) = 0 AS generic FROM r")
def f08_generic_name(spark, d):
    words = F.array(*map(F.lit, _GENERIC))
    return _names(spark, d).select("id", F.forall(names.tokens(F.col("name")), lambda t: F.array_contains(words, t)).alias("generic"))


@query(f"WITH {NAMES_SQL}, f AS (SELECT id, {_FOLD} AS folded FROM names), c AS (SELECT id, folded, count(*) OVER (PARTITION BY folded) AS n FROM f) SELECT id, n > 6 AS common FROM c")
def f09_common_name(spark, d):
    folded = _names(spark, d).select("id", names.fold(F.col("name")).alias("folded"))
    counted = folded.groupBy("folded").agg(F.count("*").alias("n"))
    return folded.join(counted, "folded").select("id", (F.col("n") > 6).alias("common"))


@query(f"WITH {NAMES_SQL} SELECT id, {_KEY} AS name_key FROM names")
def f10_name_key(spark, d):
    return _names(spark, d).select("id", names.name_key(F.col("name")).alias("name_key"))


@query()
def f11_phonetic_key(spark, d):
    return _names(spark, d).select("id", names.phonetic_key(F.col("name")).alias("phonetic_key"))


@query(f"WITH {NAMES_SQL} SELECT id, regexp_replace(lower(strip_accents(name)), '[^a-z0-9]', '', 'g') AS folded FROM names")
def f12_fold_alnum(spark, d):
    return _names(spark, d).select("id", F.regexp_replace(F.lower(names.strip_accents(F.col("name"))), "[^a-z0-9]", "").alias("folded"))


#: Pairs of part names: each with the one 7 places on.
PAIRS_SQL = "pairs AS (SELECT a.p_partkey AS id, a.p_name AS l, b.p_name AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7)"


def _pairs(spark, d):
    part = table(spark, d, "part")
    other = part.select((F.col("p_partkey") - 7).alias("id"), F.col("p_name").alias("r"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("l")).join(other, "id")


@query(f"WITH {PAIRS_SQL} SELECT id, levenshtein(l, r)::INTEGER AS distance FROM pairs")
def f13_levenshtein(spark, d):
    return _pairs(spark, d).select("id", F.levenshtein("l", "r").alias("distance"))


@query(f"WITH {PAIRS_SQL} SELECT id, round(1 - levenshtein(l, r) / greatest(len(l), len(r))::DOUBLE, 6) AS ratio FROM pairs")
def f14_levenshtein_ratio(spark, d):
    return _pairs(spark, d).select("id", F.round(similarity.levenshtein_ratio(F.col("l"), F.col("r")), 6).alias("ratio"))


#: DuckDB counts transpositions in pairs, as resolution does; deduplication counts halves, which has no SQL.
_PREFIX = "CASE WHEN substring(l, 1, 4) = substring(r, 1, 4) THEN least(4, len(l), len(r)) WHEN substring(l, 1, 3) = substring(r, 1, 3) THEN 3 WHEN substring(l, 1, 2) = substring(r, 1, 2) THEN 2 WHEN substring(l, 1, 1) = substring(r, 1, 1) THEN 1 ELSE 0 END"
_ALWAYS = f"(jaro_similarity(l, r) + 0.1 * ({_PREFIX}) * (1 - jaro_similarity(l, r)))"


@query(f"WITH {PAIRS_SQL} SELECT id, round(jaro_similarity(l, r), 4) AS jaro FROM pairs")
def f15_jaro_whole(spark, d):
    return _pairs(spark, d).select("id", F.round(similarity.jaro_whole(F.col("l"), F.col("r")), 4).alias("jaro"))


@query()
def f15_jaro_half(spark, d):
    return _pairs(spark, d).select("id", F.round(similarity.jaro(F.col("l"), F.col("r")), 4).alias("jaro"))


@query(f"WITH {PAIRS_SQL} SELECT id, round({_ALWAYS}, 4) AS jaro_winkler FROM pairs")
def f16_jaro_winkler_always(spark, d):
    return _pairs(spark, d).select("id", F.round(similarity.jaro_winkler_always(F.col("l"), F.col("r")), 4).alias("jaro_winkler"))


@query()
def f17_name_similarity(spark, d):
    best = F.greatest(similarity.jaro_winkler(F.col("l"), F.col("r")), similarity.levenshtein_ratio(F.col("l"), F.col("r")))
    return _pairs(spark, d).select("id", F.when(F.col("l") == F.col("r"), 1.0).otherwise(F.round(best, 4)).alias("similarity"))


@query()
def f18_token_similarity(spark, d):
    return _pairs(spark, d).select("id", similarity.token_similarity(names.tokens(F.col("l")), names.tokens(F.col("r"))).alias("token_similarity"))


@query(f"WITH {PAIRS_SQL} SELECT id, round(0.6 * {_ALWAYS} + 0.4 * (1 - levenshtein(l, r) / greatest(len(l), len(r))::DOUBLE), 4) AS score FROM pairs")
def f20_match_score(spark, d):
    score = similarity.match_score(similarity.jaro_winkler_always(F.col("l"), F.col("r")), similarity.levenshtein_ratio(F.col("l"), F.col("r")))
    return _pairs(spark, d).select("id", F.round(score, 4).alias("score"))


@query(
    f"WITH {NAMES_SQL}, r AS (SELECT id, {_FOLD} AS f, {_RAW} AS raw FROM names), k AS (SELECT id, unnest(['t:organization:' || substring(f, 1, 3), "
    "'s:organization:' || array_to_string(list_sort(list_transform(raw, lambda t: substring(t, 1, 1))), ''), 'n:organization:' || array_to_string(list_sort(raw), '|')]) AS block_key FROM r) "
    "SELECT block_key, count(*) AS members FROM k GROUP BY 1 HAVING count(*) > 1"
)
def f21_block_keys(spark, d):
    keys = _names(spark, d).select(F.explode(names.block_keys(F.col("name"), F.lit("Organization"))).alias("block_key"))
    return keys.groupBy("block_key").agg(F.count("*").alias("members")).where("members > 1")


_UPPER = "replace(upper(trim(name)), ' ', '-')"
_TAIL = f"(regexp_matches({_UPPER}, '^[A-Z0-9]{{1,2}}-[A-Z0-9]{{1,5}}$') OR (regexp_matches({_UPPER}, '^[A-Z0-9]{{4,7}}$') AND regexp_matches({_UPPER}, '[0-9]') AND regexp_matches({_UPPER}, '[A-Z]')))"


@query(f"SELECT p_partkey, {_TAIL} AND NOT regexp_matches({_UPPER}, '^(MV|MT|SS|MS|MY)-') AS is_tail FROM (SELECT p_partkey, ['N' || p_partkey, 'D-' || upper(substring(p_name, 1, 4)), 'MV-' || p_partkey, p_name][p_partkey % 4 + 1] AS name FROM part)")
def f25_tail_number(spark, d):
    some = F.array(F.concat(F.lit("N"), F.col("p_partkey")), F.concat(F.lit("D-"), F.upper(F.substring("p_name", 1, 4))), F.concat(F.lit("MV-"), F.col("p_partkey")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", craft.looks_like_tail(F.element_at(some, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("is_tail"))


@query(
    "WITH k AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 10000000)::VARCHAR, 7, '0') AS imo FROM orders) SELECT o_orderkey, (substring(imo, 1, 1)::INT * 7 + substring(imo, 2, 1)::INT * 6 "
    "+ substring(imo, 3, 1)::INT * 5 + substring(imo, 4, 1)::INT * 4 + substring(imo, 5, 1)::INT * 3 + substring(imo, 6, 1)::INT * 2) % 10 = substring(imo, 7, 1)::INT AS valid FROM k"
)
def f31_imo_checksum(spark, d):
    digits = F.lpad((F.col("o_orderkey") * 7919 % 10000000).cast("string"), 7, "0")
    return table(spark, d, "orders").select("o_orderkey", craft.imo_valid(digits).alias("valid"))


@query("SELECT c_custkey, regexp_replace(upper(c_mktsegment) || ', ' || c_name, '^([^,]+),\\s*(.+)$', '\\2 \\1') AS natural FROM customer")
def f34_natural_order(spark, d):
    return table(spark, d, "customer").select("c_custkey", names.natural_order(F.concat(F.upper("c_mktsegment"), F.lit(", "), F.col("c_name"))).alias("natural"))


@query(
    "SELECT c_custkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS fnv FROM customer"
)
def f35_fnv1a(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.fnv1a(F.col("c_name")).alias("fnv"))


@query("SELECT p_partkey, (2000 - least(instr(lower(p_name), 'ring') - 1, 999) + CASE WHEN instr(lower(p_name), 'ring') = 1 THEN 500 ELSE 0 END)::INTEGER AS score FROM part WHERE instr(lower(p_name), 'ring') > 0")
def f36_fuzzy_score(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fuzzy_substring("ring", F.col("p_name")).alias("score")).where("score IS NOT NULL")


@query("SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS before FROM orders")
def f37_months_before(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.months_before(F.to_date("o_orderdate"), 3).alias("before"))


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS moment FROM orders")
def f38_parse_timestamp(spark, d):
    stamp = F.col("o_orderdate")
    kinds = F.array(F.date_format(stamp, "yyyy-MM-dd"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(stamp, "EEE, d MMM yyyy HH:mm:ss 'GMT'"), F.unix_seconds(stamp.cast("timestamp")).cast("string"))
    one = F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_timestamp(one).cast("timestamp_ntz").alias("moment"))


@query("SELECT doc_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS squashed FROM documents")
def f39_squash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.squash(F.col("text"), 200).alias("squashed"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/@]+(/|$)') AS safe FROM pages")
def f40_safe_url(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("^https?://[^/@]+(/|$)").alias("safe"))


@query("SELECT doc_id, substring(text, greatest(instr(lower(text), 'the') - 45, 1), 90) AS snippet FROM documents WHERE instr(lower(text), 'the') > 0")
def f41_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), "the").alias("snippet")).where("snippet IS NOT NULL")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, greatest(0.0, round((1 - l_tax) * (CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 1.0 END) * (1 - l_discount), 6))), 6) AS confidence FROM lineitem")
def f45_compose_confidence(spark, d):
    method = F.when(F.col("l_returnflag") == "R", "cooccurrence").otherwise("dependency")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", confidence.compose(1 - F.col("l_tax"), method, 1 - F.col("l_discount")).alias("confidence"))


@query(
    "WITH m AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(x) >= 1)) AS l FROM documents) SELECT doc_id, len(l)::INTEGER AS lines FROM m"
)
def t03_distinct_lines(spark, d):
    lines = F.split(text.distinct_lines(F.col("text")), "\n")
    return table(spark, d, "documents").select("doc_id", F.when(text.distinct_lines(F.col("text")) == "", 0).otherwise(F.size(lines)).alias("lines"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::INTEGER AS tokens FROM documents")
def t11_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM pages")
def t12_strip_markup(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


@query(
    "WITH h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents) SELECT content_hash, min(doc_id) AS kept, count(*) - 1 AS duplicates FROM h GROUP BY 1"
)
def t13_merge_documents(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("duplicates"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))::INTEGER AS words FROM documents")
def t14_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))
