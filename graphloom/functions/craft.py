"""Craft and places: registrations, checksums, addresses, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def imo_valid(digits: Column) -> Column:
    """Seven digits, of which the last is the last digit of the others weighted 7 to 2."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (7 - i) for i in range(6)), F.lit(0))
    return F.when(digits.rlike("^[0-9]{7}$"), total % 10 == F.substring(digits, 7, 1).cast("int")).otherwise(False)


#: Prefixes of ships' names, which read like those of registrations.
SHIP_PREFIXES = "MT MV MS SS SY MY RV FV SV CS RMS HMS HMCS USS USNS HSC MSV FPSO FSO VLCC ULCC LPG HMT SSS TSS MVN GB CG ICGV NOAA".split()


def looks_like_tail(name: Column) -> Column:
    """An aircraft registration: a prefix, a hyphen and a body, or four to seven letters and digits, some of each."""
    upper = F.replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), F.lit(" "), F.lit("-"))
    shaped = upper.rlike("^[A-Z0-9]{1,2}-[A-Z0-9]{1,5}$") | upper.rlike("^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{4,7}$")
    return shaped & ~F.element_at(F.split(upper, "-"), 1).isin(*SHIP_PREFIXES)


def normalize_tail(value: Column) -> Column:
    """A registration as its register writes it: US numbers with N and without hyphen, others with one after the prefix."""
    plain = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9-]", "")
    return (
        F.when(plain.rlike("^N-?[0-9]{1,5}[A-Z]{0,3}$"), F.replace(plain, F.lit("-"), F.lit("")))
        .when(plain.rlike("^[0-9]{1,5}[A-Z]{0,3}$"), F.concat(F.lit("N"), plain))
        .when(plain.rlike("^[A-Z0-9]{1,2}-?[A-Z0-9]{1,5}$"), F.regexp_replace(plain, "^([A-Z0-9]{1,2})-?([A-Z0-9]{1,5})$", "$1-$2"))
        .otherwise(F.substring(plain, 1, 9))
    )


def craft_kind(name: Column, entity_type: Column) -> Column:
    """Aircraft, Vessel or Vehicle by the first signal that holds, else null."""
    upper = F.upper(name)
    return (
        F.when(entity_type != "Craft", F.lit(None).cast("string"))
        .when(looks_like_tail(name), "Aircraft")
        .when(upper.rlike("^(MV|M/V|MT|SS|MS|MY|USS|HMS) "), "Vessel")
        .when(upper.rlike("\\b[A-HJ-NPR-Z0-9]{17}\\b"), "Vehicle")
    )


#: Abbreviations in addresses, and places that are dropped from an address's end.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "sq": "square", "ter": "terrace", "hwy": "highway", "bldg": "building", "fl": "floor", "ste": "suite", "rm": "room", "ofc": "office", "apt": "apartment",
    "no": "number", "num": "number", "box": "po box", "centre": "center", "nr": "number",
}
LAST_PLACES = (
    "united kingdom|great britain|united states of america|united states|british virgin islands|cayman islands|turks and caicos|isle of man|"
    "united arab emirates|new zealand|south africa|netherlands|switzerland|luxembourg|liechtenstein|singapore|malaysia|seychelles|mauritius|panama|bahamas|"
    "bermuda|gibraltar|monaco|andorra|ireland|spain|france|germany|italy|belgium|austria|denmark|sweden|norway|finland|poland|portugal|greece|cyprus|malta|"
    "jersey|guernsey|delaware|nevada|wyoming|south dakota|florida|new york|california|texas|london|zurich|geneva"
)


def normalize_address(address: Column) -> Column:
    """Lower case, parts by commas, abbreviations spelt out, trailing countries and cities dropped."""
    lines = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), "\n", ", ")
    table = F.create_map(*(F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair))

    def spelt(part: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(part, "[^a-z0-9]+", " ")), " ")
        return F.regexp_replace(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " "), "\\bpo po box\\b", "po box")

    joined = F.array_join(F.filter(F.transform(F.split(lines, ","), spelt), lambda p: p != ""), ", ")
    return F.trim(F.regexp_replace(joined, f"((^|, | )({LAST_PLACES}),? *)+$", ""))


def address_key(address: Column) -> Column:
    return F.regexp_replace(normalize_address(address), "[^a-z0-9]", "")


def fnv_bin(value: Column, bins: int) -> Column:
    from graphloom.functions.hashing import fnv1a

    return F.pmod(fnv1a(value), F.lit(bins))
