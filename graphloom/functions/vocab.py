"""Vocabularies. The values are fixed: results depend on them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a predicate in network analysis, whatever its confidence.
EDGE_WEIGHTS = {
    "CONTROLS": 1.0, "OWNS": 1.0, "OWNED_BY": 1.0, "SUBSIDIARY_OF": 1.0, "PARENT_OF": 1.0, "ACQUIRED": 0.9,
    "SHAREHOLDER_OF": 0.9, "BENEFICIARY_OF": 0.9, "NOMINEE_OF": 0.8, "INTERMEDIARY_FOR": 0.9, "DIRECTOR_OF": 0.9,
    "OFFICER_OF": 0.9, "TRUSTEE_OF": 0.9, "FOUNDED": 0.9, "APPOINTED_BY": 0.7, "MEMBER_OF": 0.6, "EMPLOYED_BY": 0.7,
    "EMPLOYS": 0.7, "DONATED_TO": 0.7, "FUNDED": 0.8, "FUNDED_BY": 0.8, "INVESTED_IN": 0.8, "PAID_TO": 0.7,
    "TRANSFERRED_TO": 0.7, "CONTRACTED_WITH": 0.6, "REGISTERED_IN": 0.9, "NATIONAL_OF": 0.8, "LOCATED_IN": 0.7,
    "SHARES_ADDRESS": 0.8, "OPERATES_IN": 0.6, "PASSENGER_ON": 0.8, "REGISTERED_TO": 0.9, "OPERATES": 0.8,
    "TRAVELED_WITH": 0.6, "TRAVELED_TO": 0.6, "ARRIVED_FROM": 0.5, "SANCTIONED_BY": 1.0, "INVESTIGATED_BY": 0.9,
    "LINKED_OFFSHORE": 0.9, "FAMILY_OF": 0.8, "ACCUSED_OF": 0.6, "MET_WITH": 0.5, "AFFILIATED_WITH": 0.5,
    "MENTIONED_WITH": 0.4, "INFLUENCES": 1.0, "ASSOCIATED_WITH": 0.3,
}
DEFAULT_WEIGHT = 0.5
#: Predicates without a direction.
SYMMETRIC = ("MET_WITH", "FAMILY_OF", "TRAVELED_WITH", "ASSOCIATED_WITH", "AFFILIATED_WITH", "CONTRACTED_WITH", "LINKED_OFFSHORE")
#: Titles in front of a person's name, and what may follow it.
HONORIFICS = (
    "mr mrs ms miss dr prof professor sir dame lord lady hon reverend rev senator sen representative rep governor gov "
    "minister president pres captain capt general gen colonel col major maj lieutenant lt sheikh sheik shaikh haji hajj "
    "ayatollah pope king queen prince princess duke duchess baron baroness count countess czar tsar"
).split()
GENERATIONS = "jr sr ii iii iv phd md esq".split()
#: Legal forms and words that end an organisation's name.
ORG_SUFFIXES = (
    "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag sa sarl srl sas sca nv bv oy ab as "
    "asa hf ehf pty pvt private public holdings holding group enterprises international foundation trust trustee "
    "stiftung anstalt est sro spol kk kkk ooo oao pjsc jsc ojsc jscs cjsc pao doo ao to bvba oyj tbk bhd sdn pte ltda "
    "cv aps ks"
).split()
#: Institutional words, and prefixes of sports clubs.
ORG_MARKERS = (
    "bank ministry department agency commission committee university college institute charity party airlines airways "
    "shipping media newspaper channel club federation union association consortium fund authority bureau services "
    "military army navy police court parliament congress senate government municipality council directorate enterprise "
    "enterprises manufacturer refinery pipeline terminal holdings holding group"
).split()
CLUB_PREFIXES = "fc sc cf ac cd if bk sk rc".split()
#: Legal forms that are dropped before names are resolved.
LEGAL_TOKENS = (
    "gmbh mbh ag kg ug se ltd limited llc plc inc incorporated corp corporation co company sa sas sarl bv nv spa srl lp "
    "llp ooo oao zao pao ao pjsc jsc und"
).split()
#: Units of Soundex.
SOUNDEX = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}
#: Properties that identify an entity, in the order in which they are compared.
IDENTIFIERS = ("reg_number", "company_number", "lei", "imo", "mmsi", "tail_number", "icao24", "wikidata_id")


def edge_weight(predicate: Column) -> Column:
    """The weight of a predicate, ``DEFAULT_WEIGHT`` for one that isn't listed."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in EDGE_WEIGHTS.items()))
    return F.coalesce(F.try_element_at(table, predicate), F.lit(DEFAULT_WEIGHT))
