"""Names and statements in sentences, without a language model: patterns over capitals, endings and verbs."""

from __future__ import annotations

import re
from typing import NamedTuple

from graphloom.extraction import craft
from graphloom.extraction.sentences import Span, split_plain

#: Endings of organisations' names, titles of persons, and names that are nobody's.
ORG_ENDINGS = (
    "Ltd Limited Inc Incorporated LLC LLP PLC Corp Corporation Company Co GmbH AG SA SARL SRL SAS NV BV AB AS OY OJSC PJSC JSC OOO PAO Holdings Holding Group "
    "Bank Trust Foundation Partners Enterprises International Investments Capital Trading Petroleum Energy Logistics Shipping Airlines Airways Air Marine "
    "Offshore Consulting Consultants Technologies Industries"
).split()
TITLES = "Mr Mrs Ms Dr Prof President Minister Senator Director Chairman Captain General Sheikh Mr. Mrs.".split()
NOBODY = frozenset(
    "reuters|associated press|the associated press|ap|afp|agence france-presse|bloomberg|bloomberg news|getty images|getty|dpa|tass|interfax|ria novosti|"
    "the new york times|new york times|the guardian|the washington post|washington post|bbc|bbc news|cnn|al jazeera|the telegraph|financial times|"
    "wall street journal|the wall street journal|vice news|buzzfeed|buzzfeed news|the times|le monde|el pais|der spiegel|la repubblica|twitter|x|facebook|"
    "instagram|linkedin|youtube|telegram|whatsapp|wikipedia|google|internet|web|email|the company|the government|the state|the president|the minister|"
    "the official|the officials|the source|the sources|anonymous|the court|the judge|the police|the military|the army|the navy|the ministry|the committee|"
    "the board|the bank|the firm|the group|the organisation|the organization|the agency|the department|the country|the city|the region|the world|"
    "the united states|united states|the european union|european union|united nations|the un|n/a|unknown|none".split("|")
)
#: Words that make a name one of an organisation or a craft.
ORG_WORDS = frozenset(
    "ltd limited inc llc llp corp corporation company gmbh bank holdings holding group airlines airways shipping foundation trust plc ojsc pjsc ooo sarl sas "
    "nv bv partners enterprises international investments capital petroleum energy industries".split()
)
CRAFT_WORDS = "yacht vessel tanker aircraft jet helicopter ship plane convoy motorcade limousine barge trawler".split()
_NAME = r"[A-Z][\w.'’\-]+(?:\s+[A-Z][\w.'’\-]+){0,%d}"
_OBJECT = r"[A-Z][\w.'’\-]+(?:\s+[A-Z][\w.'’\-&]+){0,5}"
_ARTICLE = r"(?:a\s+|an\s+|the\s+)?"
_DOUBT = "allegedly|reportedly|purportedly|supposedly|apparently|previously|formerly|recently|later|also|once"
_ROLE = "director|chairman|founder|owner|shareholder|chief executive|ceo|president|trustee"
#: Shapes of statements, and whether the object acts.
STATEMENTS: tuple[tuple[re.Pattern, bool], ...] = tuple(
    (re.compile(shape), passive)
    for shape, passive in (
        (rf"\b(?P<s>{_NAME % 4})\s+(?P<v>owns|owned|controls|controlled|holds|held)\s+{_ARTICLE}(?P<o>{_OBJECT})\b", False),
        (rf"\b(?P<s>{_NAME % 4})\s+(?i:(?P<doubt>{_DOUBT})\s+)?(?P<v>founded|established|created|registered|incorporated|launched|acquired|bought|sold|funded|financed|sanctioned|appointed|employed|hired|met|visited|boarded|chartered|operates|operated|owns|controls|holds)\s+(?:(?P<prep>with|to|from|in|at|into|for)\s+)?{_ARTICLE}(?P<o>{_OBJECT})\b", False),
        (rf"\b(?P<s>{_NAME % 4})\s+(?i:(?P<doubt>{_DOUBT}|may have|might have|could have)\s+)?(?P<v>traveled|travelled|flew|sailed|arrived|departed|landed|docked)\s+(?P<prep>to|from|in|into|at)\s+(?P<o>{_NAME % 4})\b", False),
        (rf"\b(?P<s>{_NAME % 4}),\s+(?i:(?P<v>{_ROLE}|beneficiary))\s+of\s+(?P<o>{_OBJECT})\b", False),
        (rf"\b(?P<s>{_NAME % 4})\s+(?i:is|was)\s+{_ARTICLE}(?i:(?P<v>{_ROLE}|subsidiary|parent))\s+of\s+(?P<o>{_OBJECT})\b", False),
        (rf"\b(?P<s>{_NAME % 4})\s+(?P<v>(?i:is based in|is registered in|is located in|is domiciled in|operates in|is headquartered in))\s+(?P<o>{_NAME % 3})\b", False),
        (rf"\b(?P<s>{_NAME % 4})\s+(?P<v>(?i:is owned by|is controlled by|is funded by|is sanctioned by|was acquired by|is operated by|was founded by))\s+(?P<o>{_OBJECT})\b", True),
    )
)
_NEGATED = re.compile(r"\b(not|never|denied|refused|rejected)\b", re.I)
_HEDGED = re.compile(r"\b(allegedly|reportedly|purportedly|may|might|could)\b", re.I)
_ORG = re.compile(rf"\b([A-Z][\w.'’&\-]*(?:\s+[A-Z][\w.'’&\-]*){{0,6}}\s+(?:{'|'.join(ORG_ENDINGS)}))\b")
_TITLED = re.compile(rf"\b(?:{'|'.join(map(re.escape, TITLES))})\s+({_NAME % 3})\b")
_PERSON = re.compile(r"\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z.'’\-]{2,}){1,2})\b")
_PLACE = re.compile(rf"\b(?:in|near|from|to|at|between)\s+({_NAME % 3})\b")


class Name(NamedTuple):
    start: int
    end: int
    text: str
    label: str
    confidence: float


class Statement(NamedTuple):
    sentence: int
    subject: Name
    verb: str
    object: Name
    preposition: str
    passive: bool
    negated: bool
    hedged: bool
    distance: int
    clause: str


def trim(start: int, surface: str) -> Span:
    """A run of capitals, cut where a sentence ends inside it."""
    text = surface.strip()
    if (stop := text.find(". ")) > 0:
        text = text[:stop]
    text = text.rstrip(" .,;:")
    return Span(start, start + len(text), text)


def names(text: str | None) -> list[Name]:
    """Craft, organisations by their ending, persons by title or two names, places behind a preposition; by start."""
    text = text or ""
    found = [Name(m.start, m.end, m.identifier if m.kind in ("craft_appositive", "aircraft_registration") else m.text, "CRAFT", m.confidence) for m in craft.find(text)]
    for m in _ORG.finditer(text):
        span = trim(m.start(), m[1])
        if len(span.text.split()) >= 2:
            found.append(Name(*span, "ORG", 0.8))
    found += [Name(m.start(1), m.end(1), m[1].strip(), "PERSON", 0.85) for m in _TITLED.finditer(text)]
    for shape, label, confidence in ((_PERSON, "PERSON", 0.5), (_PLACE, "GPE", 0.55)):
        for m in shape.finditer(text):
            if any(m.start(1) < f.end and f.start < m.end(1) for f in found) or (label == "PERSON" and m[1].lower() in NOBODY):
                continue
            span = trim(m.start(1), m[1]) if label == "PERSON" else Span(m.start(1), m.end(1), m[1])
            if span.text:
                found.append(Name(*span, label, confidence))
    return sorted(found, key=lambda f: f.start)


def guess(surface: str, places: frozenset[str] = frozenset()) -> str:
    """The label of a name by its words and their number."""
    words = surface.split()
    if ORG_WORDS.intersection(re.findall(r"\w+", surface.lower())):
        return "ORG"
    if any(w in surface.lower() for w in CRAFT_WORDS):
        return "CRAFT"
    if surface in places:
        return "GPE"
    return "PERSON" if 2 <= len(words) <= 4 and all(w[:1].isupper() for w in words) else "ORG" if words else "GPE"


def known_as(span: Span, names_found: list[Name]) -> Name:
    """The longest name found that a surface means, or the surface itself with a guessed label."""
    needle = span.text.strip().lower()
    for name in sorted(names_found, key=lambda n: -len(n.text)):
        other = name.text.strip().lower()
        if needle in other or needle.startswith(other + " "):
            return Name(name.start, name.end, name.text, name.label, max(name.confidence, 0.7))
    return Name(*span, guess(span.text), 0.6)


class Found(NamedTuple):
    """A match of a pattern: where its sentence and its arguments stand, and what doesn't depend on their wording."""

    sentence: int
    start: int
    end: int
    subject: tuple[int, int]
    object: tuple[int, int]
    verb: str
    preposition: str
    passive: bool
    negated: bool
    hedged: bool


def matches(text: str) -> list[Found]:
    """What the patterns find in each sentence, with doubts and denials."""
    out: list[Found] = []
    for number, sentence in enumerate(split_plain(text)):
        for shape, passive in STATEMENTS:
            for m in shape.finditer(sentence.text):
                groups = m.groupdict()
                subject, object_ = (trim(sentence.start + m.start(g), m[g]) for g in "so")
                if not subject.text or not object_.text:
                    continue
                doubt = bool(groups.get("doubt")) or bool(_HEDGED.search(sentence.text))
                out.append(Found(
                    number, sentence.start, sentence.end, subject[:2], object_[:2], m["v"].strip().lower(), (groups.get("prep") or "").lower(), passive,
                    bool(_NEGATED.search(sentence.text)), doubt,
                ))
    return out


def told(text: str, everything: list[Name], found: list[Found]) -> list[Statement]:
    """The statements that matches of a text stand for: both arguments by the names that they mean."""
    out: list[Statement] = []
    for sentence, start, end, (a, a_end), (b, b_end), verb, preposition, passive, negated, hedged in found:
        subject, object_ = Span(a, a_end, text[a:a_end]), Span(b, b_end, text[b:b_end])
        if subject.text.lower() == object_.text.lower():
            continue
        here = [n for n in everything if start <= n.start < end]
        out.append(Statement(
            sentence, known_as(subject, here), verb, known_as(object_, here), preposition, passive, negated, hedged, abs(b - a) // 6, text[start:end]
        ))
    return out


#: Texts that differ in nothing but digits, and in which no craft can be found, have their names and matches in the same
#: places. So these are kept by the text with every digit a zero, for so many texts, none longer than that.
MOST_SHAPES, LONGEST_SHAPE = 4096, 2000
_ZEROS = bytes.maketrans(b"123456789", b"0" * 9)
_shapes: dict[bytes, tuple[list[Name], list[Found]] | None] = {}


def _by_shape(text: str) -> tuple[list[Name], list[Found]] | None:
    """Names and matches of a text, as those of its shape; None where the digits may decide what is found."""
    key = text.encode("utf-8", "surrogatepass").translate(_ZEROS)
    if key not in _shapes:
        if len(_shapes) >= MOST_SHAPES:
            _shapes.clear()
        shape = key.decode("utf-8", "surrogatepass")
        _shapes[key] = None if craft.possible(shape) else (names(shape), matches(shape))
    if (known := _shapes[key]) is None:
        return None
    return [Name(start, end, text[start : start + len(zeroed)], label, confidence) for start, end, zeroed, label, confidence in known[0]], known[1]


def statements(text: str | None) -> list[Statement]:
    """What the patterns find in each sentence, with doubts, denials and the distance of the arguments in words."""
    text = text or ""
    known = _by_shape(text) if len(text) <= LONGEST_SHAPE else None
    return told(text, *(known or (names(text), matches(text))))
