"""Registers, leaks and passenger lists as edges: (subject, predicate, object, evidence) beside what identifies a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.functions.craft import address_key, normalize_tail
from graphloom.operators.rules import first_match, link_predicate
from graphloom.sources.files import first_present

#: Other names of an aircraft register's columns.
REGISTER_COLUMNS = {
    "tail": ["n_number", "tail", "tail_number", "registration"], "owner": ["name", "owner", "registrant", "registered_owner"], "street": ["street", "street_1", "address"],
    "city": ["city"], "state": ["state"], "zip": ["zip_code", "zip"], "country": ["country"], "model": ["model", "mfr_mdl_code"],
}
#: Words of registrants that are no persons.
CORPORATE = (
    "llc inc incorporated ltd limited corp corporation company co lp llp plc trust trustee trustees bank na holdings holding group air aircraft aviation airways "
    "airlines jet jets charter leasing lease"
).split()
#: Sizes of the groups that are paired, and pairs, members or craft that one group gives.
SMALLEST, LARGEST, PAIRS, CRAFT_PAIRS = 2, 40, 24, 60


def looks_corporate(name: Column) -> Column:
    """Whether a registrant is a company, a trust or an operator."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return names.has_org_marker(name) | F.arrays_overlap(words, F.array(*map(F.lit, CORPORATE)))


def looks_like_person(label: Column) -> Column:
    """Two to four capitalised words without a corporate one."""
    return label.rlike("^\\p{Lu}[\\p{L}.'’-]*( \\p{Lu}[\\p{L}.'’-]*){1,3}$") & ~looks_corporate(label)


def humanise(name: Column) -> Column:
    """A name in capitals as it is written: ``JOHN MCKAY`` is ``John McKay``; others stay as they are."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    words = F.transform(F.split(plain, " "), lambda w: F.initcap(F.regexp_replace(w, "(['-])", "$1 ")))
    titled = F.regexp_replace(F.array_join(words, " "), "(['-]) ", "$1")
    titled = F.array_join(F.transform(F.split(titled, " "), lambda w: _scottish(_scottish(w, "Mc"), "Mac")), " ")
    return F.when((plain == F.upper(plain)) & plain.rlike("\\p{L}"), titled).otherwise(plain)


def _scottish(word: Column, head: str) -> Column:
    """A capital behind ``head`` as well."""
    n = len(head)
    raised = F.concat(F.lit(head), F.upper(F.substring(word, n + 1, 1)), F.substring(word, n + 2, 1 << 20))
    return F.when(word.startswith(head) & (F.length(word) > n), raised).otherwise(word)


def join_address(parts: list[Column]) -> Column:
    """The parts of an address that aren't empty."""
    return F.array_join(F.filter(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), lambda p: p != ""), ", ")


def aircraft_register(raw: DataFrame) -> DataFrame:
    """One row an aircraft with an owner: tail, owner, owner_type, address, address_key, country, model."""
    col = lambda name: first_present(raw, REGISTER_COLUMNS[name])
    address = join_address([col("street"), col("city"), col("state"), col("zip"), col("country")])
    owner = humanise(F.trim(F.regexp_replace(F.regexp_replace(col("owner"), "\\s+", " "), "(?i)^(registrant|owner|name)\\s*[:-]\\s*", "")))
    return raw.select(
        normalize_tail(col("tail")).alias("tail"), owner.alias("owner"), F.when(looks_corporate(owner), "Organization").otherwise("Person").alias("owner_type"),
        address.alias("address"), address_key(address).alias("address_key"), col("country").alias("country"), col("model").alias("model"),
    ).where("tail <> '' AND owner IS NOT NULL AND owner <> ''")


def register_edges(register: DataFrame) -> DataFrame:
    """Who owns each aircraft, where it is registered, and where its owner is."""
    line = F.concat(F.lit("register entry of "), "tail")
    rows = F.array(
        F.struct(F.col("owner").alias("subject"), F.lit("OWNS").alias("predicate"), F.col("tail").alias("object"), line.alias("evidence")),
        F.struct(F.col("tail").alias("subject"), F.lit("REGISTERED_IN").alias("predicate"), F.col("country").alias("object"), line.alias("evidence")),
        F.struct(F.col("owner").alias("subject"), F.lit("LOCATED_IN").alias("predicate"), F.col("address").alias("object"), line.alias("evidence")),
    )
    return register.select(F.inline(rows)).where("object IS NOT NULL AND object <> ''")


def shared_addresses(register: DataFrame) -> DataFrame:
    """Edges inside groups of owners at one address: persons pairwise, by name; of groups that are too large only where they are.

    Groups are counted before anything is paired. Of a small group, ``LARGEST`` names are held at most; of a large
    one the first ``PAIRS`` owners stay, which Spark cuts in each task before it shuffles.
    """
    owners = register.where("address_key <> ''").select("address_key", "owner", "owner_type", "address").dropDuplicates(["address_key", "owner"])
    sizes = owners.groupBy("address_key").agg(F.count("*").alias("n")).where(F.col("n") >= SMALLEST)
    sized = owners.join(sizes, "address_key")
    persons = sized.where((F.col("n") <= LARGEST) & (F.col("owner_type") == "Person"))
    grouped = persons.groupBy("address_key").agg(F.array_sort(F.collect_list("owner")).alias("people"))
    each = F.flatten(F.transform("people", lambda a, i: F.transform(F.slice("people", i + 2, F.greatest(F.size("people") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    paired = grouped.select("address_key", F.inline(F.slice(each, 1, PAIRS))).select("subject", F.lit("SHARES_ADDRESS").alias("predicate"), "object", F.concat(F.lit("both at "), "address_key").alias("evidence"))
    first = W.partitionBy("address_key").orderBy("owner")
    large = sized.where(F.col("n") > LARGEST).withColumn("k", F.row_number().over(first)).where(F.col("k") <= PAIRS)
    placed = large.select(F.col("owner").alias("subject"), F.lit("LOCATED_IN").alias("predicate"), F.col("address").alias("object"), F.concat(F.lit("one of "), F.col("n").cast("string"), F.lit(" registrants at this address")).alias("evidence"))
    return paired.unionAll(placed)


def passenger_edges(manifest: DataFrame) -> DataFrame:
    """Who was aboard (passenger, craft, date, origin, destination; owner may be there): PASSENGER_ON, and OWNS of named owners."""
    told = F.concat_ws(" ", F.lit("listed aboard"), "craft", F.concat(F.lit("on "), F.nullif("date", F.lit(""))), F.concat(F.lit("from "), F.nullif("origin", F.lit(""))), F.concat(F.lit("to "), F.nullif("destination", F.lit(""))))
    person = F.trim(F.regexp_replace(F.coalesce("passenger", F.lit("")), "\\s+", " "))
    real = (F.length(person) >= 3) & ~person.rlike("^[\\W\\d_]+$") & ~F.lower(person).rlike("^(page |sheet |table |column |row |total|subtotal)")
    aboard = manifest.where(real & (F.coalesce("craft", F.lit("")) != "")).select(person.alias("subject"), F.lit("PASSENGER_ON").alias("predicate"), F.col("craft").alias("object"), told.alias("evidence"))
    if "owner" not in manifest.columns:
        return aboard
    owned = manifest.where((F.coalesce("owner", F.lit("")) != "") & (F.coalesce("craft", F.lit("")) != ""))
    return aboard.unionAll(owned.select(F.col("owner").alias("subject"), F.lit("OWNS").alias("predicate"), F.col("craft").alias("object"), F.concat(F.lit("named owner of "), "craft").alias("evidence")))


def travelled_together(aboard: DataFrame, most: int = CRAFT_PAIRS) -> DataFrame:
    """Pairs of people on one craft in one log (log, person, craft), by name, ``most`` a craft and log.

    The pairs of the first names come first, so the first ``most`` + 1 names give all of them: longer
    lists are cut to these by the window's limit before they are paired.
    """
    people = aboard.select("log", "craft", "person").distinct()
    first = people.withColumn("k", F.row_number().over(W.partitionBy("log", "craft").orderBy("person"))).where(F.col("k") <= most + 1)
    grouped = first.groupBy("log", "craft").agg(F.array_sort(F.collect_list("person")).alias("p"))
    each = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    return grouped.select("log", "craft", F.inline(F.slice(each, 1, most))).withColumn("predicate", F.lit("TRAVELED_WITH"))


def leak_edges(rows: DataFrame) -> DataFrame:
    """Edges of a leak's rows: links between nodes by their description; jurisdictions and addresses of nodes.

    Rows have node_id, name, original_name, jurisdiction, address, link_type, start_node, start_name,
    end_node, end_name, all texts. An address of six characters or fewer, or one that repeats the jurisdiction, is none.
    """
    one = lambda *columns: F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))
    link, node, place, address = one("link_type"), one("name", "original_name", "node_id"), one("jurisdiction"), one("address")
    start, end = one("start_name", "start_node"), one("end_name", "end_node")
    linked = rows.where(link.isNotNull()).select(start.alias("subject"), link_predicate(link).alias("predicate"), end.alias("object"), F.concat(F.lit("link: "), link).alias("evidence"))
    facts = F.array(
        F.struct(node.alias("subject"), F.lit("REGISTERED_IN").alias("predicate"), place.alias("object"), F.concat(F.lit("jurisdiction: "), place).alias("evidence")),
        F.struct(
            node.alias("subject"), F.lit("LOCATED_IN").alias("predicate"),
            F.when((F.length(address) > 6) & (F.lower(address) != F.lower(F.coalesce(place, F.lit("")))), F.substring(address, 1, 120)).alias("object"),
            F.concat(F.lit("registered address: "), F.substring(address, 1, 120)).alias("evidence"),
        ),
    )
    return linked.unionAll(rows.where(link.isNull()).select(F.inline(facts))).where("subject IS NOT NULL AND object IS NOT NULL AND subject <> object")


def node_page_edges(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Edges from the connection table of a node's page: (key, subject, predicate, object, label), four links a row at most."""
    bare = lambda text: F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "\\s+", " "))
    subject = bare(F.coalesce(F.nullif(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)))
    rows = pages.select(key, subject.alias("subject"), F.explode(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    links = F.slice(F.regexp_extract_all("row", F.lit('(?is)href="[^"]*?/nodes/[0-9]+[^"]*"[^>]*>(.*?)</a>'), F.lit(1)), 1, 4)
    told = bare(F.col("row"))
    return rows.select(key, "subject", link_predicate(told).alias("predicate"), F.explode(links).alias("object"), F.substring(told, 1, 120).alias("label")).withColumn("object", bare(F.col("object"))).where("object <> '' AND object <> subject")


def company_edges(companies: DataFrame, record: str = "company") -> DataFrame:
    """Edges of company records (JSON): officers by their position, address, jurisdiction, industry codes and parent."""
    schema = (
        "name string, company_number string, jurisdiction_code string, registered_address_in_full string, officers array<struct<officer: struct<name: string, position: string>>>, "
        "industry_codes array<struct<industry_code: struct<code: string, description: string>>>, previous_names array<struct<company_name: string>>, parent_company struct<name: string>"
    )
    c = companies.withColumn("c", F.from_json(record, schema)).where("c.name IS NOT NULL AND c.name <> ''")
    edge = lambda a, p, b: F.struct(a.alias("subject"), p.alias("predicate"), b.alias("object"))
    none = F.array().cast("array<struct<subject: string, predicate: string, object: string>>")
    name = F.col("c.name")
    officers = F.coalesce(F.transform("c.officers", lambda o: edge(o["officer"]["name"], position_predicate(o["officer"]["position"]), name)), none)
    industries = F.coalesce(F.transform("c.industry_codes", lambda i: edge(name, F.lit("OPERATES_IN"), F.coalesce(i["industry_code"]["description"], i["industry_code"]["code"]))), none)
    single = F.array(
        edge(name, F.lit("REGISTERED_IN"), F.upper("c.jurisdiction_code")), edge(name, F.lit("LOCATED_IN"), F.col("c.registered_address_in_full")), edge(name, F.lit("SUBSIDIARY_OF"), F.col("c.parent_company.name")),
    )
    return c.select(F.inline(F.concat(officers, industries, single))).where("subject IS NOT NULL AND object IS NOT NULL AND object <> ''")


#: Words of a position, in this order, and the predicate each stands for.
POSITIONS = (
    ("director", "DIRECTOR_OF"), ("chair", "DIRECTOR_OF"), ("board", "DIRECTOR_OF"), ("shareholder", "SHAREHOLDER_OF"), ("owner", "OWNS"), ("founder", "FOUNDED"),
    ("trustee", "TRUSTEE_OF"), ("nominee", "NOMINEE_OF"), ("member", "MEMBER_OF"), ("agent", "INTERMEDIARY_FOR"),
)


def position_predicate(position: Column) -> Column:
    return first_match(F.coalesce(position, F.lit("")), POSITIONS, "OFFICER_OF")


def record_array(payload: Column, element: str, names_tried: tuple[str, ...] = ("records", "items", "results", "data", "entries", "rows")) -> Column:
    """The array of records in a JSON text: the text itself, or the first of some members that is one."""
    kind = F.lit(f"array<{element}>")
    some = [F.from_json(F.get_json_object(payload, f"$.{n}"), kind) for n in names_tried]
    return F.when(F.trim(payload).startswith("["), F.from_json(payload, kind)).otherwise(F.coalesce(*some))


