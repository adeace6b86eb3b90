"""What kind of company, foundation or craft an entity is, how opaque it is, and the labels that follow.

Entities have the columns ``name``, ``entity_type`` and ``properties`` (a map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.craft import address_key, looks_like_tail

#: Jurisdictions without a public register of owners, and registers that don't disclose them.
SECRECY = (
    "vg|vgb|bvi|british virgin islands|virgin islands, british|ky|cym|cayman|cayman islands|bs|bhs|bahamas|bm|bmu|bermuda|ai|aia|anguilla|tc|tca|"
    "turks and caicos|ms|msr|montserrat|gi|gib|gibraltar|pa|pan|panama|bz|blz|belize|vc|vct|st vincent|saint vincent|st vincent and the grenadines|kn|kna|"
    "st kitts|saint kitts and nevis|lc|lca|st lucia|saint lucia|gd|grd|grenada|ag|atg|antigua|antigua and barbuda|dm|dma|dominica|sv|slv|el salvador|pr|pri|"
    "puerto rico|vi|vir|us virgin islands|mh|mhl|marshall islands|ws|wsm|samoa|american samoa|vu|vut|vanuatu|ck|cok|cook islands|nu|niu|niue|pw|plw|palau|nr|"
    "nru|nauru|to|ton|tonga|ki|kir|kiribati|tv|tuv|tuvalu|fm|fsm|micronesia|gu|gum|guam|sc|syc|seychelles|mu|mus|mauritius|mv|mdv|maldives|my-lbn|labuan|"
    "ae-rk|ras al khaimah|rak|jebel ali|dubai|cw|cuw|curacao|curaçao|aw|abw|aruba|sx|sxm|sint maarten"
).split("|")
OPACITY = (
    "us-de|delaware|us-nv|nevada|us-sd|south dakota|us-wy|wyoming|lu|lux|luxembourg|ch|che|switzerland|zug|geneva|li|lie|liechtenstein|mc|mco|monaco|ad|and|"
    "andorra|nl|nld|netherlands|pt-30|madeira|cy|cyp|cyprus|mt|mlt|malta|je|jey|jersey|gg|ggy|guernsey|im|imn|isle of man|ae|are|united arab emirates|bh|bhr|"
    "bahrain|qa|qat|qatar|kw|kwt|kuwait|om|omn|oman|hk|hkg|hong kong|sg|sgp|singapore|my|mys|malaysia|bn|brn|brunei|nz|nzl|new zealand"
).split("|")
#: Words of foundations and trusts.
FOUNDATIONS = (
    "foundation|stichting|stiftung|fondation|fundacion|fundación|fondazione|fundação|stiftelsen|säätiö|fond|fonds|trust|trustee|trustees|family trust|"
    "unit trust|treuhand|fiducie|fideicomiso|fiducia|waqf|wakala|charity|charitable|charitable trust|ngo|nonprofit|non-profit|endowment|philanthrop|"
    "philanthropic|benevolent|anstalt|establishment|st ecc|ecclesiastical|donor advised|daf|giving fund|relief fund|aid fund|institute|institut|instituto|"
    "think tank|society|vereniging|association|associazione|asociacion|club|fraternal|order of|lodge"
).split("|")
#: Where a jurisdiction is looked up, in this order.
JURISDICTION_KEYS = (
    "jurisdiction jurisdiction_code jurisdiction_description incorporation_jurisdiction registered_jurisdiction country country_codes countries flag "
    "registry_country state"
).split()
#: States of companies that don't trade, and words of vehicles that never do.
DORMANT = (
    "dormant|dissolved|struck off|struck-off|inactive|closed|cancelled|canceled|expired|liquidated|in liquidation|wound up|defunct|lapsed|revoked|terminated"
).split("|")
HOLDING_WORDS = (
    "holdings holding investments investment ventures capital enterprises international group assets properties property estates estate trading commercial "
    "consultants consulting services management partners associates overseas offshore global worldwide universal general continental transnational nominees "
    "nominee"
).split()
#: Signs of ships, aircraft and vehicles.
SHIP_SIGNS = (
    "vessel|ship|yacht|superyacht|motor yacht|sailboat|barge|ferry|tanker|container ship|cruise|boat|imo|mmsi|flag state|gross tonnage|tonnage"
).split("|")
AIRCRAFT_SIGNS = (
    "aircraft|airplane|aeroplane|jet|plane|helicopter|airliner|airframe|icao|iata|airworthiness|tail number|tailnumber|serial number|mode s|airworth"
).split("|")
VEHICLE_SIGNS = (
    "vehicle|car|automobile|truck|lorry|bus|coach|limousine|vin|chassis|registration plate|number plate|licence plate|motorcycle|armoured|armored"
).split("|")
_YES = ("1", "true", "yes")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _get(props: Column, key: str) -> Column:
    """A property without the spaces around it; null where it is missing or empty."""
    value = F.trim(F.try_element_at(props, F.lit(key)))
    return F.when(value != "", value)


def _has(props: Column, *keys: str) -> Column:
    return F.coalesce(*(_get(props, k) for k in keys)).isNotNull()


def _yes(props: Column, *keys: str) -> Column:
    return F.coalesce(F.lower(F.coalesce(*(_get(props, k) for k in keys))).isin(*_YES), F.lit(False))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _holds(text: Column, signs) -> Column:
    return F.exists(_array(signs), lambda s: F.contains(text, s))


def jurisdiction_class(name: Column, props: Column) -> Column:
    """``secrecy``, ``opacity`` or empty: by the jurisdiction on record, else by the words of the name."""
    text = F.coalesce(F.lower(F.coalesce(*(_get(props, k) for k in JURISDICTION_KEYS))), _plain(name))
    words = F.array_union(F.split(text, "\\s+"), F.array(text))
    return (
        F.when(F.arrays_overlap(words, _array(SECRECY)), "secrecy").when(F.arrays_overlap(words, _array(OPACITY)), "opacity")
        .when(_holds(text, [s for s in SECRECY if len(s) > 3]), "secrecy").otherwise("")
    )


def is_foundation(name: Column, props: Column) -> Column:
    form = F.lower(F.coalesce(*(_get(props, k) for k in ("organization_kind", "company_type", "legal_form")), F.lit("")))
    words = F.split(_plain(name), " ")
    some = _holds(_plain(name), ("family trust", "charitable trust", "donor advised", "stichting", "anstalt"))
    return _holds(form, FOUNDATIONS) | _yes(props, "is_foundation") | F.arrays_overlap(words, _array(FOUNDATIONS)) | some


def shell_risk(name: Column, entity_type: Column, props: Column) -> Column:
    """The struct (score, reasons) of a company's opacity: what each sign adds or takes, held between 0 and 1."""
    name, kind = F.trim(F.coalesce(name, F.lit(""))), jurisdiction_class(name, props)
    status = F.lower(F.coalesce(_get(props, "status"), _get(props, "company_status"), F.lit("")))
    count = F.coalesce(_get(props, "shared_address_count").try_cast("int"), F.lit(0))
    shared = F.concat(count.cast("string"), F.lit(" companies share this registered address"))
    signs = (
        (kind == "secrecy", 0.35, F.lit("secrecy jurisdiction")),
        (kind == "opacity", 0.12, F.lit("registry does not disclose beneficial owners")),
        (_holds(status, DORMANT), 0.2, F.concat(F.lit("non-trading status: "), F.substring(status, 1, 40))),
        (~_has(props, "reg_number", "company_number", "lei"), 0.1, F.lit("no registration number on record")),
        (F.arrays_overlap(F.split(_plain(name), " "), _array(HOLDING_WORDS)), 0.1, F.lit("holding-vehicle name marker")),
        (name.rlike("(?i)^(company|entity|node|record|officer)\\s*#?[0-9]*$"), 0.3, F.lit("placeholder name (redacted vehicle)")),
        (name.rlike("(?i)\\(\\s*(bvi|panama|seychelles|cayman|samoa|belize|vanuatu|nevis)\\s*\\)"), 0.1, F.lit("jurisdiction named in the company name")),
        (_yes(props, "nominee", "is_nominee") | _has(props, "nominee_of"), 0.25, F.lit("nominee shareholder/director")),
        (_has(props, "beneficial_owner", "beneficiary_of"), 0.1, F.lit("beneficial owner disclosed separately")),
        (_has(props, "intermediary", "service_provider", "intermediary_of"), 0.1, F.lit("formed through an intermediary")),
        (count >= 5, 0.2, shared), ((count >= 2) & (count < 5), 0.1, shared),
        (_yes(props, "is_offshore"), 0.15, F.lit("flagged offshore by the source")),
        (_has(props, "icij_node_id", "icij_id"), 0.15, F.lit("appears in an offshore leaks release")),
        (_has(props, "website", "phone", "employees"), -0.1, F.lit("has trading presence (website/phone/staff)")),
    )
    company = (entity_type == "Organization") & ~is_foundation(name, props)
    score = sum((F.when(sign, F.lit(points)).otherwise(0.0) for sign, points, _ in signs), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(sign, reason) for sign, _, reason in signs)))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4)))
    return F.struct(F.when(company, held).otherwise(0.0).alias("score"), F.when(company, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def is_shell(name: Column, entity_type: Column, props: Column) -> Column:
    return shell_risk(name, entity_type, props)["score"] >= 0.5


def craft_label(name: Column, props: Column) -> Column:
    """Aircraft, Vessel or Vehicle by identifiers, then by words, then by the shape of the name; else Craft."""
    kind = F.lower(F.coalesce(_get(props, "craft_kind"), _get(props, "craft_type"), F.lit("")))
    words = F.lower(F.concat_ws(" ", kind, F.coalesce(_get(props, "model"), F.lit("")), name))
    return (
        F.when(_has(props, "registration", "tail_number", "icao_hex") & ~_holds(kind, ("vessel", "ship", "yacht")), "Aircraft")
        .when(_has(props, "imo", "mmsi", "vessel_prefix"), "Vessel").when(_has(props, "vin", "plate", "chassis"), "Vehicle")
        .when(_holds(words, SHIP_SIGNS), "Vessel").when(_holds(words, AIRCRAFT_SIGNS), "Aircraft").when(_holds(words, VEHICLE_SIGNS), "Vehicle")
        .when(looks_like_tail(name), "Aircraft").otherwise("Craft")
    )


def labels(name: Column, entity_type: Column, props: Column) -> Column:
    """All labels that an entity has now."""
    company = entity_type == "Organization"
    foundation = is_foundation(name, props)
    offshore = _yes(props, "is_offshore") | (company & (jurisdiction_class(name, props) == "secrecy"))
    return F.array_distinct(F.array_compact(F.array(
        F.lit("Entity"), F.when(entity_type.isin("Person", "Organization", "Location", "Craft"), entity_type), F.when(company & foundation, "Foundation"),
        F.when(company & ~foundation, "Company"), F.when(company & is_shell(name, entity_type, props), "ShellCompany"),
        F.when(entity_type == "Craft", craft_label(name, props)), F.when(offshore, "Offshore"),
    )))


def stale_labels(current: Column) -> Column:
    """Labels that exclude one of the current ones, to be taken off."""
    families = (("Company", "Foundation"), ("Aircraft", "Vessel", "Vehicle"))
    parts = [F.when(F.arrays_overlap(current, _array(f)), F.array_except(_array(f), current)).otherwise(F.array().cast("array<string>")) for f in families]
    return F.concat(*parts)


def gps(value: Column) -> Column:
    """``lat,lon`` with six digits from any text that holds two numbers inside the bounds, else null."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9.,+-]+", " "), "[\\s,]+"), lambda p: p != "")
    lat, lon = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(inside, F.concat(F.format_string("%.6f", lat), F.lit(","), F.format_string("%.6f", lon)))


def extras(name: Column, entity_type: Column, props: Column, aliases: Column) -> Column:
    """Derived properties of an entity, as a map without empty values."""
    risk = shell_risk(name, entity_type, props)
    others = F.array_sort(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: (a != "") & (a != name)))
    company, craft, place = entity_type == "Organization", entity_type == "Craft", entity_type == "Location"
    address = F.coalesce(_get(props, "address"), name)
    tail = F.substring(F.replace(F.upper(F.coalesce(_get(props, "tail_number"), _get(props, "registration"))), F.lit(" "), F.lit("-")), 1, 16)
    values = {
        "alias": F.substring(F.get(others, F.lit(0)), 1, 200), "shell_risk": F.when(risk["score"] > 0, risk["score"].cast("string")),
        "is_shell": F.when(risk["score"] > 0, (risk["score"] >= 0.5).cast("string")), "jurisdiction_class": F.when(company, jurisdiction_class(name, props)),
        "craft_kind": F.when(craft, F.coalesce(_get(props, "craft_kind"), craft_label(name, props))), "tail_number": F.when(craft, tail),
        "owner": F.when(craft, F.substring(F.coalesce(_get(props, "owner"), _get(props, "registrant"), _get(props, "registered_owner")), 1, 200)),
        "address": F.when(place, F.substring(address, 1, 400)), "address_key": F.when(place, F.substring(address_key(address), 1, 200)),
        "gps": F.when(place, gps(F.coalesce(_get(props, "gps"), _get(props, "coordinates"), _get(props, "location")))),
    }
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull() & (v != ""))
