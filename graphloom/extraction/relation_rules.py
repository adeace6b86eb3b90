"""From a verb, a role or a preposition and the types of its arguments to a predicate, as joins with rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vocab import SYMMETRIC

#: Rules by predicate: words, types of the subject and of the object (first letters, empty for any),
#: evidence, priority, whether the arguments change places. Verbs are given by their lemma and irregular forms.
VERBS = (
    ("OWNS", "own hold held possess", "PO", "OCL", 0.98, 6, False), ("SHAREHOLDER_OF", "stake invest subscribe underwrite", "PO", "O", 0.9, 5, False),
    ("OWNS", "hold held", "", "C", 0.9, 4, False), ("CONTROLS", "control dominate direct run manage head lead led chair", "PO", "OC", 0.88, 7, False),
    ("ACQUIRED", "acquire buy bought purchase absorb", "PO", "OC", 0.95, 7, False), ("FOUNDED", "found establish create register incorporate launch form", "PO", "O", 0.95, 7, False),
    ("DIRECTOR_OF", "direct serve sit sat", "P", "O", 0.85, 5, False), ("OFFICER_OF", "officiate hold", "P", "O", 0.8, 3, False),
    ("APPOINTED_BY", "appoint nominate name install designate elect promote hire recruit", "PO", "P", 0.9, 6, True),
    ("EMPLOYED_BY", "work employ join staff serve consult lobby", "P", "O", 0.85, 5, False), ("EMPLOYS", "employ hire recruit contract retain", "O", "P", 0.9, 6, False),
    ("MEMBER_OF", "join belong member affiliate enrol enroll", "PO", "O", 0.85, 5, False),
    ("FUNDED", "fund finance bankroll sponsor donate give gave grant lend lent loan", "PO", "PO", 0.92, 6, False),
    ("PAID_TO", "pay paid transfer transferred wire remit remitted send sent invoice settle", "", "", 0.85, 5, False),
    ("CONTRACTED_WITH", "contract sign award procure tender", "", "", 0.85, 5, False), ("TRANSFERRED_TO", "transfer transferred move shift relocate reassign cede", "", "", 0.8, 4, False),
    ("LOCATED_IN", "locate base headquarter situate reside live domicile", "", "L", 0.92, 6, False), ("REGISTERED_IN", "register incorporate file flag flagged domicile", "", "L", 0.95, 8, False),
    ("NATIONAL_OF", "naturalise naturalize born citizen", "", "L", 0.85, 5, False), ("OPERATES_IN", "operate serve", "", "L", 0.85, 5, False),
    ("TRAVELED_TO", "travel travelled fly flew flown sail arrive land visit go goes went journey proceed return reach", "", "L", 0.92, 7, False),
    ("ARRIVED_FROM", "depart leave left originate", "", "L", 0.85, 6, False), ("TRAVELED_WITH", "accompany board embark join", "", "PCO", 0.88, 6, False),
    ("OPERATES", "operate fly flew sail crew pilot commandeer charter lease deploy", "", "C", 0.92, 8, False), ("REGISTERED_TO", "register flag flagged", "", "C", 0.92, 7, False),
    ("MET_WITH", "meet met confer conferred host receive visit", "PO", "PO", 0.9, 7, False),
    ("FAMILY_OF", "marry divorce father mother brother sister son daughter sibling spouse relative cousin nephew niece wed", "", "", 0.85, 6, False),
    ("SANCTIONED_BY", "sanction blacklist designate ban banned restrict block freeze froze frozen penalise penalize punish", "", "POC", 0.95, 8, True),
    ("INVESTIGATED_BY", "investigate probe examine scrutinise scrutinize audit search raid question summon", "", "PO", 0.9, 7, True),
    ("ACCUSED_OF", "accuse charge indict suspect allege blame convict sue prosecute", "", "PO", 0.85, 6, True),
    ("LINKED_OFFSHORE", "link tie connect associate relate implicate reveal expose", "", "", 0.8, 4, False),
    ("AFFILIATED_WITH", "affiliate ally partner cooperate collaborate support back endorse", "", "", 0.85, 4, False),
    ("ASSOCIATED_WITH", "involve include mention name appear list", "", "", 0.7, 1, False),
)
GERMAN_VERBS = (
    ("OWNS", "besitzen innehaben", "PO", "OCL", 0.98, 6, False), ("SHAREHOLDER_OF", "halten", "PO", "O", 0.85, 5, False), ("OWNED_BY", "gehören", "", "PO", 0.9, 6, False),
    ("ACQUIRED", "erwerben kaufen übernehmen aufkaufen", "PO", "OC", 0.95, 7, False), ("FOUNDED", "gründen errichten", "PO", "O", 0.95, 7, False),
    ("CONTROLS", "leiten führen kontrollieren steuern lenken verwalten beaufsichtigen", "PO", "OC", 0.88, 7, False),
    ("FUNDED", "finanzieren fördern subventionieren kreditieren", "PO", "PO", 0.92, 6, False), ("DONATED_TO", "spenden stiften", "PO", "PO", 0.85, 5, False),
    ("PAID_TO", "zahlen bezahlen entrichten", "", "", 0.85, 5, False), ("TRANSFERRED_TO", "überweisen verkaufen veräußern übertragen abtreten liefern", "", "", 0.8, 4, False),
    ("INVESTED_IN", "investieren beteiligen", "PO", "O", 0.85, 5, False), ("EMPLOYS", "beschäftigen anstellen einstellen", "O", "P", 0.9, 6, False),
    ("CONTRACTED_WITH", "beauftragen engagieren", "", "", 0.85, 5, False), ("MEMBER_OF", "angehören beitreten", "PO", "O", 0.85, 5, False),
    ("MET_WITH", "treffen begegnen", "PO", "PO", 0.9, 7, False), ("FAMILY_OF", "heiraten ehelichen", "P", "P", 0.85, 6, False),
    ("OPERATES", "betreiben chartern bereedern", "", "C", 0.9, 8, False), ("LOCATED_IN", "sitzen liegen wohnen leben residieren befinden", "", "L", 0.85, 5, False),
    ("TRAVELED_TO", "reisen fliegen segeln landen ankommen fahren", "", "L", 0.85, 6, False), ("ARRIVED_FROM", "abfliegen abfahren abreisen starten", "", "L", 0.8, 5, False),
    ("SANCTIONED_BY", "sanktionieren", "", "POC", 0.95, 8, True), ("ACCUSED_OF", "beschuldigen anklagen verklagen verurteilen verdächtigen", "", "PO", 0.85, 6, True),
    ("APPOINTED_BY", "ernennen berufen nominieren wählen bestellen", "", "P", 0.9, 6, True),
)
NOUNS = (
    ("DIRECTOR_OF", "director|directors|board member|board|chairman|chairwoman|chair|chairperson|non-executive director|supervisory board|trustee|governor|regent", "PO", "O", 0.9, 8, False),
    ("OFFICER_OF", "ceo|chief executive|cfo|chief financial officer|coo|chief operating officer|president|vice president|managing director|executive|officer|manager|head|chief|secretary|treasurer|chair", "", "", 0.88, 7, False),
    ("OWNS", "owner|owners|proprietor|beneficial owner|beneficiary|holder|shareholder|stockholder|investor|controller", "", "", 0.92, 8, False),
    ("FOUNDED", "founder|founders|co-founder|cofounder|creator|establisher", "", "", 0.92, 8, False),
    ("SUBSIDIARY_OF", "subsidiary|subsidiaries|unit|division|arm|affiliate|branch|wholly-owned subsidiary|joint venture", "", "", 0.9, 7, False),
    ("PARENT_OF", "parent|parent company|holding company|holdings", "", "", 0.88, 7, True),
    ("EMPLOYED_BY", "employee|staff|staffer|worker|personnel|contractor|consultant|advisor|adviser|counsel|lawyer|accountant|lobbyist|fixer|agent|spokesman|spokeswoman|spokesperson", "", "", 0.8, 5, False),
    ("MEMBER_OF", "member|members|party member|delegate|representative|mp|senator|lawmaker|politician", "", "", 0.82, 5, False),
    ("FAMILY_OF", "wife|husband|spouse|son|daughter|brother|sister|father|mother|uncle|aunt|nephew|niece|cousin|relative|widow|fiancé|fiancée|son-in-law|daughter-in-law|stepson|stepdaughter", "P", "P", 0.9, 8, False),
    ("AFFILIATED_WITH", "partner|partners|business partner|joint partner|affiliate|ally|allies", "OP", "O", 0.8, 6, False),
    ("NATIONAL_OF", "national|citizen|resident|passport holder|dual national", "P", "L", 0.85, 6, False),
    ("INTERMEDIARY_FOR", "intermediary|middleman|broker|proxy|nominee|front|shell company|shell firm|offshore vehicle|fixer|facilitator|agent|law firm|trustee", "", "", 0.88, 7, False),
    ("OPERATES", "operator|operators|carrier|airline|shipowner|ship owner|manager|flight|vessel|aircraft|jet|yacht", "", "", 0.85, 6, False),
    ("SHAREHOLDER_OF", "stake|share|shares|shareholding|equity|interest", "", "", 0.85, 6, False),
    ("LOCATED_IN", "headquarters|hq|office|offices|address|registered address|registered office|base|residence|domicile|registry", "", "", 0.85, 6, False),
    ("SANCTIONED_BY", "sanction|sanctions|blacklist|denial list|specially designated national|sdn|consolidated list", "", "", 0.9, 7, False),
    ("ASSOCIATED_WITH", "associate|associates|ally|allies|colleague|confidant|friend|aide|aides|associate of|partner|business partner", "P", "P", 0.75, 4, False),
    ("ASSOCIATED_WITH", "associate|associates|ally|allies|colleague|confidant|friend|aide|aides|associate of", "", "", 0.75, 3, False),
)
PREPOSITIONS = (
    ("LOCATED_IN", "in|at|near|inside|within", "", "L", 0.8, 5, False), ("REGISTERED_IN", "in", "OC", "L", 0.82, 6, False), ("MEMBER_OF", "of|in", "P", "O", 0.7, 4, False),
    ("TRAVELED_WITH", "with|alongside|together with|aboard|on board|on", "", "PC", 0.82, 6, False), ("TRAVELED_TO", "to|into|toward|towards|for", "", "L", 0.85, 6, False),
    ("ARRIVED_FROM", "from|out of", "", "L", 0.8, 5, False), ("EMPLOYED_BY", "for|at|with", "P", "O", 0.75, 5, False),
    ("AFFILIATED_WITH", "with|alongside", "", "", 0.7, 3, False), ("OWNS", "of", "PO", "OC", 0.6, 2, False),
)
#: Verbs that move something to whom "to" names; cues of doubt and of denial, in English and German.
TRANSFERS = "sell sold divest offload export ship shipped convey assign transfer transferred move relocate cede hand".split()
HEDGES = (
    "alleged allegedly reported reportedly claimed purported purportedly supposedly apparently may might could would presumably rumored rumoured suspected "
    "believed understood speculated unverified unconfirmed angeblich vermutlich mutmaßlich vermeintlich womöglich offenbar soll sollen sollte sollten dürfte "
    "dürften würde würden könne könnte könnten berichtet behauptet behauptete unbestätigt spekuliert gerüchteweise möglicherweise"
).split()
DENIALS = (
    "not|never|no|neither|nor|n't|denied|denies|deny|refuted?|rejects?|rejected|without|absent|disputed?|disputes|nicht|kein\\w*|nie|niemals|weder|ohne|mangels|"
    "dementier\\w*|bestreit\\w*|bestritten"
)
#: Auxiliaries in front of a verb and particles behind it.
AUXILIARIES = (
    "be been being am is are was were have has had do does did will would shall should can could may might must get gets got become becomes became remain "
    "remains remained"
).split()
PARTICLES = "by to of in for with from on at into upon up out over through".split()


def forms(lemma: str) -> set[str]:
    """A verb's lemma and its regular forms."""
    if lemma.endswith("y") and lemma[-2:-1] not in "aeiou":
        return {lemma, lemma[:-1] + "ies", lemma[:-1] + "ied"}
    return {lemma, lemma + ("es" if lemma.endswith(("s", "x", "ch", "sh")) else "s"), lemma + ("d" if lemma.endswith("e") else "ed")}


def _listed(kind: str, extra: tuple = ()) -> list[tuple]:
    rules = {"verb": VERBS + GERMAN_VERBS, "noun": NOUNS, "preposition": PREPOSITIONS}[kind] + tuple(extra)
    rows = []
    for number, (predicate, words, subjects, objects, evidence, priority, reverse) in enumerate(rules):
        some = {f for w in words.split() for f in (forms(w) if rules[number] not in GERMAN_VERBS else {w})} if kind == "verb" else set(words.split("|"))
        rows += [(w, predicate, subjects, objects, evidence, priority, reverse, number) for w in sorted(some)]
    return rows


def table(spark: SparkSession, kind: str, extra: tuple = ()) -> DataFrame:
    """Rules of one kind (``verb``, ``noun``, ``preposition``), one row a word; ``extra`` ones come behind those of their priority."""
    return spark.createDataFrame(_listed(kind, extra), "word string, predicate string, subjects string, objects string, evidence double, priority int, reverse boolean, number int")


def normal_verb(phrase: Column) -> Column:
    """A verb phrase without auxiliaries, a trailing particle and a regular ending."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(phrase, F.lit("")), "\\s+", " ")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, f"^(?:(?:{'|'.join(AUXILIARIES)}) +)+", ""), f" +(?:{'|'.join(PARTICLES)})$", ""))
    # the longest ending that leaves three letters; each pattern reads the one before once
    return F.regexp_replace(F.regexp_replace(bare, "(?s)^(.{3,})(?:ied|ies)\\z", "$1y"), "(?s)^(.{3,}?)(?:ing|ed|es|s)\\z", "$1")


def single_consonant(stem: Column) -> Column:
    """A stem without the doubling that an ending left."""
    return F.when(stem.rlike("^.{2,}([b-df-hj-np-tv-z])\\1$"), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def cues(sentence: Column) -> tuple[Column, Column]:
    """Whether a sentence is in doubt, and whether it is denied."""
    plain = F.coalesce(sentence, F.lit(""))
    return tuple(plain.rlike(f"(?iu)(?<![\\p{{L}}\\p{{N}}_])({words})(?![\\p{{L}}\\p{{N}}_])") for words in ("|".join(HEDGES), DENIALS))


def type_default(subject: Column, object_: Column, generic: bool = False) -> Column:
    """The predicate of two types where no rule fits; ``generic`` for entities that only occur together."""
    craft = (subject == "Craft") | (object_ == "Craft")
    if generic:
        return (
            F.when(craft & (object_ == "Location"), "TRAVELED_TO").when(craft, "TRAVELED_WITH").when(object_ == "Location", "LOCATED_IN")
            .when((subject == "Person") & (object_ == "Person"), "MET_WITH").otherwise("ASSOCIATED_WITH")
        )
    return (
        F.when((subject == "Person") & (object_ == "Organization"), "AFFILIATED_WITH").when((subject == "Organization") & (object_ == "Organization"), "ASSOCIATED_WITH")
        .when(object_ == "Location", "LOCATED_IN").when((object_ == "Craft") & (subject == "Person"), "TRAVELED_WITH").when(object_ == "Craft", "OPERATES")
        .otherwise("ASSOCIATED_WITH")
    )


def together(left: Column, right: Column, distance: Column, most: int = 30) -> tuple[Column, Column]:
    """Predicate and evidence of two entities of one sentence that no statement relates."""
    near = F.least(F.lit(0.3), 0.3 * F.greatest(F.lit(0), distance) / float(most)) if most > 0 else F.lit(0.0)
    return type_default(left, right, generic=True), F.round(F.greatest(F.lit(0.4), 1.0 - near), 4)


def _best(rows: DataFrame, words: list[Column], kind: str, extra: tuple) -> DataFrame:
    """Rows (subject_type, object_type) with ``_words`` and the struct ``_rule`` of the best rule for one of them.

    The table has some hundred words, so it is broadcast, once a word of ``words``, with the best rule of each pair of
    first letters of the types: no row of ``rows`` is shuffled or met again.
    """
    listed = _listed(kind, extra)
    letters = ["", *sorted({x for r in listed for x in r[2] + r[3]}), "-"]  # no type at all fits all rules, "-" those for any
    best: dict[str, list] = {}
    for word, predicate, subjects, objects, evidence, priority, reverse, number in listed:
        of_word = best.setdefault(word, [None] * len(letters) ** 2)
        for i, pair in enumerate((a, b) for a in letters for b in letters):
            if all(not allowed or x in allowed for x, allowed in zip(pair, (subjects, objects))):
                new = (priority, -number, predicate, evidence, reverse)
                of_word[i] = new if of_word[i] is None else max(of_word[i], new)
    rules = rows.sparkSession.createDataFrame(list(best.items()), "word string, rules array<struct<priority: int, order: int, predicate: string, evidence: double, reverse: boolean>>")
    place = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, letters[:-1])), F.substring(t, 1, 1)), F.lit(0)), F.lit(len(letters))).cast("int") - 1
    out = rows.withColumns({f"_w{i}": w for i, w in enumerate(words)} | {"_pair": place("subject_type") * len(letters) + place("object_type")})
    for i in range(len(words)):
        out = out.join(F.broadcast(rules.select(F.col("word").alias(f"_w{i}"), F.col("rules").alias(f"_r{i}"))), f"_w{i}", "left")
    met = [F.get(f"_r{i}", F.col("_pair")) for i in range(len(words))]
    return out.withColumns({"_rule": F.greatest(*met) if len(met) > 1 else met[0], "_words": F.array(*(F.col(f"_w{i}") for i in range(len(words))))})


def decided(rows: DataFrame, kind: str, extra: tuple = ()) -> DataFrame:
    """``rows`` with the struct ``decision`` of what ``decide`` returns for each, row by row."""
    own = rows.columns
    rows = rows.withColumns(dict(zip(("_hedged", "_negated"), cues(F.col("sentence")))))  # before the rules are met: read once
    raw = F.lower(F.trim(F.coalesce(F.col("word"), F.lit(""))))
    if kind == "verb":
        rows = rows.withColumns({"_raw": raw, "_head": F.element_at(F.split(raw, " +"), 1)})
        rows = rows.withColumns({"_stem": normal_verb(F.col("_raw")), "_head_stem": normal_verb(F.col("_head"))})
        words = [F.col("_raw"), F.col("_stem"), single_consonant(F.col("_stem")), F.col("_head"), F.col("_head_stem"), single_consonant(F.col("_head_stem"))]
    else:
        words = [raw]
    found = _best(rows, words, kind, extra).withColumn("_doubt", F.when(F.col("_hedged"), 0.75).otherwise(1.0))
    default = {"verb": 0.6, "noun": 0.55, "preposition": 0.5}[kind]
    moves = F.lit(False)
    if kind == "verb":
        moving = F.arrays_overlap("_words", F.array(*(F.lit(f) for w in TRANSFERS for f in sorted(forms(w)))))
        moves = F.col("preposition").isin("to", "into", "toward", "towards") & moving

    def decision(rule: Column) -> Column:
        transfer = moves & (rule.isNull() | (rule["priority"] < 5))
        by_rule = F.greatest(F.lit(0.05), rule["evidence"] * F.when(F.col("passive"), 0.95).otherwise(1.0) * F.col("_doubt"))
        return F.struct(
            F.when(transfer, "TRANSFERRED_TO").when(rule.isNotNull(), rule["predicate"]).otherwise(type_default(F.col("subject_type"), F.col("object_type"))).alias("predicate"),
            F.when(transfer | rule.isNull(), False).otherwise(rule["reverse"]).alias("reverse"),
            F.round(F.when(transfer, 0.85 * F.col("_doubt")).when(rule.isNotNull(), by_rule).otherwise(default), 4).alias("evidence"),
            F.col("_hedged").alias("hedged"), F.col("_negated").alias("negated"), F.when(transfer | rule.isNotNull(), kind).otherwise("type_default").alias("matched_on"),
        )

    # one decision a row, but as an exploded list: filters on it then don't repeat it, and the generated code stays small enough to be compiled
    return found.select(*own, F.explode(F.transform(F.array("_rule"), decision)).alias("decision"))


def decide(rows: DataFrame, kind: str, extra: tuple = ()) -> DataFrame:
    """Predicate, direction and evidence of rows (id, word, subject_type, object_type, sentence, preposition, passive).

    ``kind`` says what the words are. A verb of transfer with "to" is TRANSFERRED_TO unless a strong rule says
    otherwise; without a rule the types decide, with the evidence .6 for a verb, .55 for a noun and .5 for a
    preposition. Doubt takes a quarter of the evidence, a passive a twentieth. Returns id, predicate, reverse,
    evidence, hedged, negated, matched_on.
    """
    return decided(rows, kind, extra).select("id", "decision.*")


def evidence_score(evidence: Column, distance: Column, passive: Column, embedded: Column | None = None) -> Column:
    """Evidence less what distance, a subordinate clause and a passive take from it."""
    far = F.when(distance > 6, F.greatest(F.lit(0.6), 1.0 - 0.02 * (distance - 6))).otherwise(1.0)
    inner = F.when(embedded, 0.9).otherwise(1.0) if embedded is not None else F.lit(1.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), evidence * far * inner * F.when(passive, 0.95).otherwise(1.0))), 4)


def relations(statements: DataFrame, weight: float = 0.4, least: float = 0.05) -> DataFrame:
    """Typed relations of statements (id, subject, subject_type, verb, object, object_type, preposition, passive, negated, hedged, distance, sentence).

    Denied statements, self-loops and what falls under ``least`` are left out; a passive and a reversing rule
    each turn the arguments round, and predicates without a direction have theirs in order.
    """
    said = statements.where(~F.col("negated") & (F.col("subject") != F.col("object"))).select(
        "id", "subject", "object", F.col("verb").alias("word"), "subject_type", "object_type", "sentence", "preposition", F.lit(False).alias("passive"),
        F.col("passive").alias("turned"), "distance", F.col("hedged").alias("doubted"),
    )
    joined = decided(said, "verb").select("id", "subject", "object", F.col("turned").alias("passive"), "distance", "doubted", "decision.*")
    joined = joined.where(~F.col("negated")).withColumn("hedged", F.col("hedged") | F.col("doubted"))
    turn = F.col("reverse") | F.col("passive")
    a, b = F.when(turn, F.col("object")).otherwise(F.col("subject")), F.when(turn, F.col("subject")).otherwise(F.col("object"))
    confidence = F.round(F.least(F.lit(1.0), weight * evidence_score(F.col("evidence"), F.col("distance"), F.col("passive"))), 6)
    loose = F.col("predicate").isin(*SYMMETRIC)
    return (
        joined.select("id", a.alias("a"), b.alias("b"), "predicate", confidence.alias("confidence"), "hedged")
        .where(F.col("confidence") >= least)
        .select("id", F.when(loose, F.least("a", "b")).otherwise(F.col("a")).alias("subject"), "predicate", F.when(loose, F.greatest("a", "b")).otherwise(F.col("b")).alias("object"), "confidence", "hedged")
    )
