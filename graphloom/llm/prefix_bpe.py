"""SentencePiece encoding and decoding by a merge-type prefix table.

Byte-pair encoding has the property that each prefix of a text ends in one certain token: the one
token that ends there and is compatible with the last token of the prefix before it, two tokens being
compatible when the merges applied to both together leave them as they are. An Aho-Corasick automaton
lists the tokens that end at a position, pair tests (remembered) pick the right one, and the ids are
recovered backwards from the last position. Time is linear in the text. New words made of frequent
characters go through numpy side by side, one position of all of them at a time; others are taken in
sorted order, so that the table of a prefix shared with the word before is kept.

No piece of a model trained with ``split_by_whitespace`` crosses from a character to a following
space, so a text is cut into words that each keep the spaces before them and are remembered while
there is room. Where a vocabulary does have such pieces, the text is encoded as one. Most texts have
single spaces only and line ends that no piece holds: these are cut by ``str.split`` into words and
line starts, looked up by one ``map``, and joined; where each word decodes to itself, so does the text.

Defined cases: a null text counts as the empty one, which has no ids; a character outside the
vocabulary becomes its UTF-8 bytes; repeated rows come out as often as they go in; an empty table
gives an empty result; columns other than the id and the text are never read, whatever their names. Ids
are whole numbers.
"""

from __future__ import annotations

import hashlib
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow

SPACE = "▁"
#: Words that a worker remembers in each of two generations, pairs and steps; a full memory is emptied.
WORDS, PAIRS, STEPS, LONGEST_WORD = 200_000, 600_000, 600_000, 48
#: Characters that the side-by-side table has a column for, and slots of its memory of pairs (a power of two).
COLUMNS, SLOTS = 192, 1 << 21
#: Characters that are cut into words at a time.
PIECE = 1 << 21
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The place of a model among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Automaton:
    """Aho-Corasick whose state is a number, so that a scan can go on from any earlier position."""

    def __init__(self, tokens: dict[str, int]):
        self.outputs: list[tuple[tuple[int, int], ...]] = [()]
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        for token, number in tokens.items():
            state = 0
            for c in map(ord, token):
                after = edges.get(state << 21 | c)
                if after is None:
                    after = edges[state << 21 | c] = len(children)
                    children[state].append((c, after))
                    children.append([])
                    self.outputs.append(())
                state = after
            self.outputs[state] = ((len(token), number),)
        self.fails = [0] * len(children)
        layer = [n for _, n in children[0]]
        while layer:
            below = []
            for state in layer:
                self.outputs[state] += self.outputs[self.fails[state]]
                for c, after in children[state]:
                    back = self.fails[state]
                    while back and back << 21 | c not in edges:
                        back = self.fails[back]
                    self.fails[after] = edges.get(back << 21 | c, 0)
                    below.append(after)
            layer = below
        self.edges = edges
        self.steps = dict(edges)

    def step(self, state: int, c: int) -> int:
        """The state after one more character; remembered."""
        back = state
        while back and back << 21 | c not in self.edges:
            back = self.fails[back]
        if len(self.steps) >= len(self.edges) + STEPS:
            self.steps.clear()
            self.steps.update(self.edges)
        found = self.steps[state << 21 | c] = self.edges.get(back << 21 | c, 0)
        return found


class PrefixBpe:
    """Encoder and decoder of one BPE model file without normalisation rules.

    The model is read through the public library (vocabulary, scores, kinds); encoding and decoding
    are done here.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.special = {i: model.is_control(i) for i in special}
        self.value_of = {i: b for b, i in self.bytes.items()}
        self._plain = max(special, default=-1) + 1  # from this id on, an id is its piece
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        probe = sentencepiece.SentencePieceNormalizer(model_file=path)
        # what the normaliser does is asked of it, not assumed: a space in front, spaces kept or not
        self.prefix = SPACE if model.encode("a", out_type=str)[0].startswith(SPACE) else ""
        if probe.normalize("a  ﬁ ").replace(" ", SPACE).lstrip(SPACE) != f"a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("models that normalise the text are not handled")
        self.single_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # whether a line end is a cut of its own, and texts may be cut by spaces and line ends alone
        self._simple = bool(self.single_words and self.prefix and self.bytes) and not any("\n" in p for p in self.ids)
        self._quick: dict[str, str] = {}
        self._quick_older: dict[str, str] = {}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}
        # pieces that merges can't reach never occur
        self._reachable = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self._rank = {self.ids[p]: r for r, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]))}
        self._split = self._halves()
        self._unordered: set[int] = set()
        for token in sorted(self._split, key=lambda t: len(self.pieces[t])):
            if any(h in self._split and (h in self._unordered or self._rank[h] > self._rank[token]) for h in self._split[token]):
                self._unordered.add(token)
        self._automaton = Automaton(self._reachable)
        self._side = SideBySide(self) if self._simple else None

    def merge(self, text: str) -> list[str]:
        """Apply the merges to one short string: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self) -> dict[int, tuple[int, int]]:
        """For each token that merges make of two, the two of its last merge."""
        found = {}
        for token, number in self._reachable.items():
            parts = list(token)
            while len(parts) > 2:
                at = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                found[number] = (self.ids[parts[0]], self.ids[parts[1]])
        return found

    def _stays(self, a: int, b: int) -> bool:
        """Whether the merges leave neighbours ``a`` and ``b`` as they are.

        The last merges inside both are undone in the reverse of their order. Whenever what stands at the
        border could merge across it before the merge that was undone last, the pair would not have come about.
        Tokens with a part that ranks behind the whole have no such order: there the merges are applied.
        """
        if a in self._unordered or b in self._unordered:
            return self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        rank, halves, joined = self._rank, self._split, self._joined
        # what was merged to get the present state: (rank, 0 left of the border or 1 right of it)
        undone = (np.inf, 1)
        while True:
            across = joined(a, b)
            # a merge across the border starts left of one on its right, and right of one on its left
            if across is not None and (across < undone[0] or (across == undone[0] and undone[1])):
                return False
            left, right = rank[a] if a in halves else -1, rank[b] if b in halves else -1
            if left < 0 and right < 0:
                return True
            if left > right:
                undone, a = (left, 0), halves[a][1]
            else:  # of equal merges that on the left comes first, so that on the right is undone first
                undone, b = (right, 1), halves[b][0]

    def _joined(self, a: int, b: int) -> int | None:
        """The rank of the merge of two tokens, None where there is none."""
        token = self.ids.get(self.pieces[a] + self.pieces[b])
        return None if token is None else self._rank[token]

    def _compatible(self, a: int, b: int) -> bool:
        """As ``_stays``; remembered."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        known = self._pairs[a * len(self.pieces) + b] = self._stays(a, b)
        return known

    def _extend(self, text: str, states: list[int], last: list[int]) -> None:
        """Carry the prefix table on from ``len(last)`` to the end of the text.

        ``last``: for each position the id of the last token of the prefix that ends there, -1 for a
        character outside the vocabulary. ``states``: the automaton's state after each position.
        """
        steps, outputs = self._automaton.steps, self._automaton.outputs
        known, size = self._pairs.get, len(self.pieces)
        state = states[-1] if states else 0
        for end in range(len(last), len(text)):
            c = ord(text[end])
            after = steps.get(state << 21 | c)
            state = self._automaton.step(state, c) if after is None else after
            states.append(state)
            for length, token in outputs[state]:
                before = end - length
                if before < 0 or (previous := last[before]) < 0:
                    last.append(token)
                    break
                fits = known(previous * size + token)
                if fits or (fits is None and self._compatible(previous, token)):
                    last.append(token)
                    break
            else:
                last.append(-1)

    def _recover(self, text: str, last: list[int]) -> list[int]:
        """The ids, from the last position backwards."""
        pieces, out, at = self.pieces, [], len(text) - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= len(pieces[token])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in reversed(text[at].encode("utf-8"))]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at -= 1
        out.reverse()
        return out

    def _learn(self, words: set[str]) -> dict[str, tuple[str, int, str]]:
        """Encode new words: decimal ids joined by commas, how many, and their text, spaces still marked."""
        found: dict[str, tuple[str, int, str]] = {}
        states: list[int] = []
        last: list[int] = []
        before = ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del states[same:], last[same:]
            self._extend(word, states, last)
            before = word
            ids = self._recover(word, last)
            surface = "".join([self.pieces[i] for i in ids]) if min(ids) >= self._plain else self.surface(ids)
            # the same text is kept as the word itself: no second string to remember
            found[word] = (",".join(map(str, ids)), len(ids), word if surface.replace(" ", SPACE) == word else surface)
        return found

    def _lookup(self, lists: list[list[str]]) -> list[list[tuple[str, int, str]]]:
        """What is known or learnt of each word."""
        found = [list(map(self._words.get, words)) for words in lists]
        new = {w for words, known in zip(lists, found, strict=True) if None in known for w, f in zip(words, known, strict=True) if f is None}
        if not new:
            return found
        fresh = {w: self._older[w] for w in new if w in self._older}
        fresh |= self._learn(new - fresh.keys())
        found = [
            [f or fresh[w] for w, f in zip(words, known, strict=True)] if None in known else known
            for words, known in zip(lists, found, strict=True)
        ]
        for word, value in fresh.items():
            if len(word) <= LONGEST_WORD:
                self._words[word] = value
        if len(self._words) >= WORDS:
            self._older, self._words = self._words, {}
        return found

    def _cut(self, piece: str) -> list[str]:
        return _WORD.findall(piece) if self.single_words else [piece]

    def _pieces(self, text: str):
        """The text with its spaces marked, in stretches that end where a word ends."""
        marked = self.prefix + text.replace(" ", SPACE) if text else ""
        start = 0
        while self.single_words and len(marked) - start > PIECE:
            cut = marked.find(SPACE, start + PIECE)
            while cut > 0 and marked[cut - 1] == SPACE:  # not inside a run of spaces
                cut = marked.find(SPACE, cut + 1)
            if cut < 0:
                break
            yield marked[start:cut]
            start = cut
        if start < len(marked):
            yield marked[start:]

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self._pieces(text) for found in self._lookup([self._cut(piece)]) for ids, _, _ in found for i in ids.split(",")]

    def surface(self, ids: list[int]) -> str:
        """The text of some ids, the space in front still there."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.value_of:
                raw.append(self.value_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i is not None and i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i is not None and not self.special[i]:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        found = self.surface(ids)
        return found[1:] if self.prefix and found.startswith(" ") else found

    def _quick_words(self, text: str) -> list[str]:
        """Words by single spaces, a line's first word behind its line end; the space before a word is left out."""
        return (text.replace("\n", " \n") if "\n" in text else text).split(" ")

    def _quick_lists(self, lists: list[list[str]]) -> list[list[str | None]]:
        """The ids of each word as decimal text, None for a word that has to be encoded in its context."""
        quick, older = self._quick, self._quick_older
        new = set().union(*lists) - quick.keys()
        seen = new & older.keys()
        quick.update((w, older[w]) for w in seen)
        new -= seen
        quick.update(dict.fromkeys(new))
        new.discard("")  # two spaces in a row, or one at an end
        done, others = self._side.encode(new)
        quick.update(done)
        marked = {w if w.startswith("\n") else SPACE + w: w for w in others}
        for word, (ids, _, surface) in self._learn(set(marked)).items():
            if surface == word and SPACE not in marked[word]:  # it decodes to itself
                quick[marked[word]] = ids
        found = [list(map(quick.__getitem__, words)) for words in lists]
        for word in others:  # the others are few, and may be long
            del quick[word]
        if len(quick) >= WORDS:
            self._quick_older, self._quick = quick, {}
        return found

    def results(self, texts: list[str]) -> list[tuple[int, str, str, str]]:
        """For each text the number of ids, the ids joined by commas, and SHA-256 of these and of the decoded text."""
        out: list[tuple[int, str, str, str]] = []
        group: list[str] = []
        size = 0
        for text in [*texts, None]:
            if group and (text is None or size + len(text) > PIECE):
                out += self._group_results(group)
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
        return out

    def _group_results(self, group: list[str]) -> list[tuple[int, str, str, str]]:
        plain = self._simple and (len(group) > 1 or len(group[0]) <= PIECE)
        quick = self._quick_lists([self._quick_words(t) for t in group]) if plain else [[None]] * len(group)
        out = []
        for text, known in zip(group, quick, strict=True):
            if None in known or not text:
                out.append(self._slow_result(text))
            else:
                ids = ",".join(known)
                out.append((ids.count(",") + 1, ids, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()))
        return out

    def _slow_result(self, text: str) -> tuple[int, str, str, str]:
        """Word by word with the spaces that each has before it."""
        ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
        total, joined = 0, []
        for piece in self._pieces(text):
            ids, counts, surfaces = zip(*self._lookup([self._cut(piece)])[0], strict=True)
            decoded = "".join(surfaces).replace(SPACE, " ")
            if not total and self.prefix and decoded.startswith(" "):
                decoded = decoded[1:]
            total += sum(counts)
            joined.append(",".join(ids))
            text_hash.update(decoded.encode("utf-8"))
        ids = ",".join(joined)
        ids_hash.update(ids.encode())
        return total, ids, ids_hash.hexdigest(), text_hash.hexdigest()


class SideBySide:
    """The prefix table of many words at once, for words of frequent characters."""

    def __init__(self, model: PrefixBpe):
        self.model, self.size = model, len(model.pieces)
        often = Counter(c for piece in model._reachable for c in set(piece) if ord(c) < 1 << 14)
        letters = sorted(sorted(often, key=lambda c: (-often[c], c))[:COLUMNS])
        self.column = np.full(1 << 14, -1, np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(len(letters))
        tokens = {p: i for p, i in model._reachable.items() if set(p) <= set(letters)}
        automaton = Automaton(tokens)
        count = len(automaton.fails)
        self.table = np.zeros((count, len(letters)), np.int32)
        below: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for edge, after in automaton.edges.items():
            below[edge >> 21].append((self.column[edge & 0x1FFFFF], after))
        layer = [0]
        while layer:  # a state's row is that of the state it falls back to, but for its own edges
            reached = []
            for state in layer:
                if state:
                    self.table[state] = self.table[automaton.fails[state]]
                for column, after in below[state]:
                    self.table[state, column] = after
                    reached.append(after)
            layer = reached
        deep = max(map(len, automaton.outputs))
        self.tokens = np.full((count, deep), -1, np.int32)
        for state, found in enumerate(automaton.outputs):
            self.tokens[state, : len(found)] = [token for _, token in found]
        self.length = np.array([len(p) for p in model.pieces], np.int32)
        self.text = [str(i) for i in range(self.size)]
        self.line_end = self.text[model.bytes[10]]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.held = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or would go."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)
        away = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(away):
            at[away] = (at[away] + 1) & (SLOTS - 1)
            away = away[(self.keys[at[away]] != keys[away]) & (self.keys[at[away]] >= 0)]
        return at

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Pair tests, each distinct pair once."""
        keys = before.astype(np.int64) * self.size + token
        at = self._slots(keys)
        if (self.keys[at] < 0).any():
            new = np.unique(keys[self.keys[at] < 0])
            if self.held + len(new) > SLOTS // 2:
                self._clear()
                new = np.unique(keys)
            self.held += len(new)
            stays, size = self.model._stays, self.size
            values = np.fromiter((stays(*divmod(key, size)) for key in new.tolist()), bool, len(new))
            while len(new):  # of keys that want one slot, one at a time goes in
                spots, first = np.unique(self._slots(new), return_index=True)
                self.keys[spots], self.values[spots] = new[first], values[first]
                rest = np.ones(len(new), bool)
                rest[first] = False
                new, values = new[rest], values[rest]
            at = self._slots(keys)
        return self.values[at]

    def encode(self, words: set[str]) -> tuple[list[tuple[str, str]], list[str]]:
        """(word, ids as decimal text) of the words that decode to themselves for certain, and the other words.

        A word that doesn't begin with a line end has a space before it, which is left out.
        """
        by_length: list[list[str]] = [[] for _ in range(LONGEST_WORD + 1)]
        others = []
        for word in words:
            (by_length[len(word)] if len(word) <= LONGEST_WORD and SPACE not in word else others).append(word)
        done: list[tuple[str, str]] = []
        for line_end in (False, True):
            fit = [w for some in reversed(by_length) for w in some if (w[0] == "\n") == line_end]
            for start in range(0, len(fit), 16384):
                a, b = self._encode(fit[start : start + 16384], line_end)
                done += a
                others += b
        return done, others

    def _encode(self, words: list[str], line_end: bool) -> tuple[list[tuple[str, str]], list[str]]:
        """``words`` by falling length, all of them with a line end in front or none."""
        lengths = np.fromiter(map(len, words), np.int32, len(words)) + (0 if line_end else 1)
        marked = "".join(words).replace("\n", SPACE) if line_end else SPACE + SPACE.join(words)
        flat = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        width = int(lengths[0])
        inside = np.arange(width) < lengths[:, None]
        columns = np.zeros((len(words), width), np.int32)
        columns[inside] = np.where(flat < 1 << 14, self.column[np.minimum(flat, (1 << 14) - 1)], -1)
        if line_end:  # what stands first is its own token, which nothing joins
            columns, lengths, width = columns[:, 1:], lengths - 1, width - 1
        good = (columns >= 0).all(1)
        columns = np.maximum(columns, 0)
        last = np.full((len(words), width), -1, np.int32)
        state = np.zeros(len(words), np.int32)
        for p in range(width):
            m = int(np.searchsorted(-lengths, -p, side="left"))  # words longer than p come first
            state = self.table[state[:m], columns[:m, p]]
            rows, deep = np.flatnonzero(good[:m]), 0
            while len(rows) and deep < self.tokens.shape[1]:
                token = self.tokens[state[rows], deep]
                none = token < 0
                if none.any():  # left to the other way
                    good[rows[none]] = False
                    rows, token = rows[~none], token[~none]
                before = p - self.length[token]
                fits = before < 0
                asked = np.flatnonzero(~fits)
                if len(asked):
                    fits[asked] = self._fits(last[rows[asked], before[asked]], token[asked])
                last[rows[fits], p] = token[fits]
                rows, deep = rows[~fits], deep + 1
            good[rows] = False
        rows = np.flatnonzero(good & (lengths > 0))
        at, owners, tokens = lengths[rows] - 1, [], []
        alive = np.arange(len(rows))
        while len(alive):  # backwards from the last position
            token = last[rows[alive], at[alive]]
            owners.append(alive)
            tokens.append(token)
            at[alive] -= self.length[token]
            alive = alive[at[alive] >= 0]
        done = [(w, self.line_end) for w, n in zip(words, lengths.tolist(), strict=True) if not n]
        if len(rows):
            owner, token = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
            ranked = np.argsort(owner, kind="stable")
            ids, ends = list(map(self.text.__getitem__, token[ranked].tolist())), np.cumsum(np.bincount(owner, minlength=len(rows))).tolist()
            before = self.line_end + "," if line_end else ""
            done += [(words[row], before + ",".join(ids[a:b])) for row, a, b in zip(rows.tolist(), [0, *ends], ends)]
        return done, [words[i] for i in np.flatnonzero(~good).tolist()]


def _utf8(raw: bytes) -> str:
    """UTF-8 as the library reads it: each byte that starts no valid character is one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[str, PrefixBpe] = {}
_LOCK = threading.Lock()


def loaded(path: str) -> PrefixBpe:
    """The model of a path, read once a process."""
    with _LOCK:
        if path not in _LOADED:
            _LOADED[path] = PrefixBpe(path)
        return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``, and ``ids`` if asked for.

    ``path`` is read on the executors, as the installed tokenizers are; by default it is resolved there.
    """

    def make():
        model = loaded(path or model_path())

        def each(batch: pa.RecordBatch) -> dict:
            found = model.results([t or "" for t in batch.column(1).to_pylist()])
            counts, ids, hashes, texts = zip(*found, strict=True)
            out = {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": hashes, "decoded_sha256": texts}
            return out | ({"ids": _as_lists(ids, counts)} if with_ids else {})

        return each

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(plain, schema, make, ["doc_id", "text"])


def _as_lists(ids: tuple[str, ...], counts: tuple[int, ...]) -> pa.Array:
    """Texts of decimal ids as lists of whole numbers."""
    flat = [np.fromstring(text, np.int32, sep=",") for text in ids if text]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``: the token ids themselves."""
    return encode_decode(docs, path, with_ids=True).select("doc_id", "ids")
