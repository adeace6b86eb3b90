"""Sentences with absolute offsets, and windows of whole sentences that fit a model's context."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

CONTEXT, OVERLAP, MOST_SENTENCES = 384, 64, 1_500
#: Abbreviations that end with a dot and no sentence; in plain English text, and in several languages.
ENGLISH = frozenset(
    "mr mrs ms messrs dr prof profs sr jr st mt no nos vs etc al ibid gov sen rep gen col capt lt maj adm rev hon pres supt det insp fig figs vol vols pp "
    "para ch sec art jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k u.s.a u.e d.c a.m p.m e.g i.e cf approx".split()
)
ABBREVIATIONS = ENGLISH | frozenset("sra srta z.b u.a d.h bzw ca nr abs bspw usw sr. sra. ud uds m mme mlle".split())
#: Months, in front of which a day's dot ends nothing.
MONTHS = frozenset(
    "january february march april may june july august september october november december januar februar maerz märz mai juni juli oktober dezember enero "
    "febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier fevrier février mars avril juin juillet aout août "
    "septembre octobre novembre decembre décembre janeiro fevereiro março maio junho julho setembro outubro novembro dezembro gennaio febbraio aprile "
    "maggio giugno luglio settembre ottobre dicembre январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()
)
_CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
#: What ends a sentence, in scripts with and without spaces; pieces of a text that count as tokens.
_END = re.compile(r"[.!?…]+(?:\s?[\"'”’»›)\]]+)*(?=\s|$)|[。！？؟]+(?:\s?[\"'”’»›)\]]+)*(?=\S|$)")
_PIECE = re.compile(rf"[{_CJK}]|[^\W_]+(?:\.[^\W_]+)*|\d+(?:[.,]\d+)*|[^\w\s]")
_WORD = re.compile(rf"[{_CJK}]|\S+")
_PLAIN_END, _PLAIN_START = re.compile(r"[.!?][\"\')\]]*(?=\s|$)"), re.compile(r"[A-Z0-9\"\'“‘(\[]")


class Span(NamedTuple):
    start: int
    end: int
    text: str


class Chunk(NamedTuple):
    start: int
    end: int
    text: str
    tokens: int
    first: int
    last: int
    cut: bool


def tokens(text: str) -> int:
    """An estimate of a text's tokens: long pieces count by six characters, and a tenth is added."""
    if not text:
        return 0
    return max(1, math.ceil(sum(math.ceil(len(p) / 6) if len(p) > 12 else 1 for p in _PIECE.findall(text)) * 1.1))


def _trimmed(text: str, start: int, end: int) -> Span | None:
    inner = text[start:end]
    lead = len(inner) - len(inner.lstrip())
    body = inner.strip()
    return Span(start + lead, start + lead + len(body), body) if body else None


def _goes_on(line: str, dot: int, end: int) -> bool:
    """Whether what looks like an end of sentence at ``dot`` is none: an abbreviation, a date, a number, a small letter."""
    after = line[end:].lstrip()
    word = line[: dot + 1].split()[-1:] or [""]
    token = word[0].strip("\"'“‘(«»").lower()
    token = token[:-1] if token.endswith(".") else token
    if token in ABBREVIATIONS or (len(token) == 1 and token.isalpha()):
        return True
    if token.isdigit() and len(token) <= 2 and (month := re.match(r"[^\W\d_]+", after)) and month[0].lower() in MONTHS:
        return True
    return bool(after) and (after[0].islower() or (after[0].isdigit() and line[max(0, dot - 1) : dot].isdigit()))


def split(text: str | None, most: int = MOST_SENTENCES) -> list[Span]:
    """Sentences of a text in any of several languages; a line's end always ends one."""
    out: list[Span] = []
    for line in re.finditer(r"[^\n]+", text or ""):
        ends = sorted({m.end() for m in _END.finditer(line[0]) if not _goes_on(line[0], m.start(), m.end())})
        for start, end in zip([0, *ends], [*ends, len(line[0])]):
            if (span := _trimmed(text, line.start() + start, line.start() + end)) is not None:
                out.append(span)
                if len(out) >= most:
                    return out
    return out


def split_plain(text: str | None, most: int = MOST_SENTENCES) -> list[Span]:
    """Sentences of English text for the statement patterns; a sentence begins with a capital, a digit or a quote."""
    out: list[Span] = []
    for line in re.finditer(r"\S[^\n]*", text or ""):
        cuts = [0]
        for m in _PLAIN_END.finditer(line[0]):
            word = re.search(r"[A-Za-z][A-Za-z.]*$", line[0][max(0, m.start() - 30) : m.start() + 1])
            after = line[0][m.end() :].lstrip()
            if not (word and word[0].lower().rstrip(".") in ENGLISH) and (not after or _PLAIN_START.match(after)):
                cuts.append(m.end())
        for start, end in zip(cuts, [*cuts[1:], len(line[0])]):
            if (span := _trimmed(text, line.start() + start, line.start() + end)) is not None:
                out.append(span)
                if len(out) >= most:
                    return out
    return out


def _cut_word(span: Span, number: int, word: re.Match, count: int, most: int, overlap: int):
    """Windows over one word that is longer than the context."""
    width = max(1, int(len(word[0]) * most / max(1, count)))
    step = max(1, width - int(width * overlap / most))
    for at in range(0, len(word[0]), step):
        part = word[0][at : at + width]
        start = span.start + word.start() + at
        yield Chunk(start, start + len(part), part, min(most, tokens(part)), number, number, True)
        if at + width >= len(word[0]):
            return


def _cut_sentence(span: Span, number: int, most: int, overlap: int):
    """Windows of whole words over one sentence that is longer than the context."""
    words = list(_WORD.finditer(span.text))
    sizes = [tokens(w[0]) for w in words]
    at = 0
    while at < len(words):
        if sizes[at] > most:
            yield from _cut_word(span, number, words[at], sizes[at], most, overlap)
            at += 1
            continue
        end, used = at, 0
        while end < len(words) and (end == at or used + sizes[end] <= most):
            used, end = used + sizes[end], end + 1
        part = span.text[words[at].start() : words[end - 1].end()]
        start = span.start + words[at].start()
        yield Chunk(start, start + len(part), part, tokens(part), number, number, True)
        if end >= len(words):
            return
        back, again = end, 0  # whole words are repeated while they fit, but one new word comes at least
        while back > at and again + sizes[back - 1] <= overlap:
            back -= 1
            again += sizes[back]
        at = back if at < back < end else end


def chunks(text: str | None, most: int = CONTEXT, overlap: int = OVERLAP, sentences: int = MOST_SENTENCES) -> list[Chunk]:
    """Windows of ``most`` tokens at most: whole sentences, the last of which are repeated for ``overlap`` tokens at most.

    Only a sentence that is longer than a window is cut, which its chunks say.
    """
    if most < 8 or not 0 <= overlap < most:
        raise ValueError("a window holds 8 tokens at least, and more than are repeated")
    spans = split(text, sentences)
    sizes = [tokens(s.text) for s in spans]
    out: list[Chunk] = []
    at = 0
    while at < len(spans):
        if sizes[at] > most:
            out += _cut_sentence(spans[at], at, most, overlap)
            at += 1
            continue
        end, used = at + 1, sizes[at]
        while end < len(spans) and used + sizes[end] + 1 <= most:
            used, end = used + sizes[end] + 1, end + 1
        start, stop = spans[at].start, spans[end - 1].end
        out.append(Chunk(start, stop, text[start:stop], tokens(text[start:stop]), at, end - 1, False))
        if end >= len(spans):
            break
        back, again = end, 0
        while back > at:
            cost = sizes[back - 1] + (1 if back - 1 > at else 0)
            if again + cost > overlap:
                break
            back, again = back - 1, again + cost
        at = back if at < back < end and again + sizes[end] + 1 <= most else end
    return out
