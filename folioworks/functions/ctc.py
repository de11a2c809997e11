"""Decoding of per-timestep class probabilities: best path, beam search with a lexicon,
certainties, character boundaries and words. The best path reads characters of one code, the beam
search characters of one code or several."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from .lexicon import NO_PERM, TOP_CHOICE_PERM, Lexicon

#: Fixed values of scoring.
MIN_CERTAINTY, CERTAINTY_OFFSET, DICT_RATIO, CERTAINTY_SCALE = -20.0, -0.085, 2.25, 7.0
BEAM, SPACE, WORST_DICT = 5, 0, -25.0 / CERTAINTY_SCALE
NO_CHARACTER = -1


class Symbol(NamedTuple):
    char: int
    start: int
    end: int
    certainty: float = 0.0
    rating: float = 0.0


def certainty(p: float) -> float:
    return math.log(p) if p > math.exp(MIN_CERTAINTY) else MIN_CERTAINTY


def greedy(probs: np.ndarray, blank: int, chars: dict[int, int]) -> list[Symbol]:
    """Runs of the first best code, blanks dropped."""
    best = probs.argmax(1)
    cut = np.flatnonzero(np.diff(best, prepend=-1))
    out = []
    for a, b in zip(cut, [*cut[1:], len(best)]):
        if best[a] != blank:
            if best[a] not in chars:
                raise ValueError(f"code {best[a]} at {a} stands for no character")
            out.append(Symbol(chars[best[a]], int(a), int(b)))
    return out


def score(probs: np.ndarray, symbols: Sequence[Symbol], ratio: float = 1.0) -> list[Symbol]:
    """A symbol answers for the timesteps after the one before it; the last one for all to the end."""
    each = [(certainty(float(p)) + CERTAINTY_OFFSET) * ratio for p in probs.max(1)]
    out, begin = [], 0
    for i, s in enumerate(symbols):
        span = each[begin : len(each) if i == len(symbols) - 1 else s.end]
        out.append(s._replace(certainty=min([0.0, *span]), rating=-sum(span)))
        begin = s.end
    return out


def boundaries(symbols: Sequence[Symbol], width: int) -> list[int]:
    """Ends halfway between neighbours; only the width if there is none."""
    if not symbols:
        return [width]
    return [0, *(a.end + (b.start - a.end) // 2 for a, b in zip(symbols, symbols[1:])), width]


def confidence(c: float) -> float:
    return min(100.0, max(0.0, 100 + 5 * CERTAINTY_SCALE * c))


def split_words(symbols: Sequence[Symbol]) -> list[tuple[int, int, float]]:
    """(first, after the last, certainty of the worse space beside it) of runs without spaces."""
    out, space, first = [], 0.0, None
    for i, s in enumerate([*symbols, None]):
        if s is not None and s.char != SPACE:
            first = i if first is None else first
            continue
        if first is not None:
            out.append((first, i, min(space, s.certainty) if s is not None else space))
            first = None
        if s is not None:
            space = s.certainty
    return out


def word_bounds(bounds: Sequence[int], first: int, after: int, scale: float, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    x0 = box[0] + math.floor(bounds[first] * scale)
    return x0, box[1], max(x0 + 1, box[0] + math.ceil(bounds[after] * scale)), box[3]


# -- beam search -------------------------------------------------------------
#
# A hypothesis is a row of the table Rows. Each timestep has two parts. moves() lists, as
# arrays, how the live hypotheses may go on by the rules of CTC and by the codes of characters:
# which code, with which certainty, and what may follow. Two readings of the moves make
# offers, by the rows of RULES: any text, at a discount, and words of the lexicon. Offers are
# ranked once; each state keeps its BEAM best distinct ones. Nothing is decided before all
# offers of a timestep are known.
#
# A character has one code or several. What a hypothesis has of an unfinished character is its
# prefix; a code may follow if some character's codes go on so, blanks and repeats may always.

#: What may follow a hypothesis: anything; only a repeat of it; no repeat of it.
ANY, ONLY_REPEAT, NO_REPEAT = 0, 1, 2
#: Tiers of codes at a timestep: the two best and the blank, the next three, the others.
TOP2, TOPN, REST = 0, 1, 2


def tiers(row: np.ndarray, blank: int) -> tuple[np.ndarray, set[int]]:
    """(tier of every code, the two best codes); the earlier code wins ties."""
    order = np.lexsort((np.arange(len(row)), -row))[:BEAM]
    out = np.full(len(row), REST)
    out[order] = TOPN
    out[order[:2]] = TOP2
    out[blank] = TOP2
    return out, set(order[:2].tolist())


def certainties(p: np.ndarray) -> np.ndarray:
    """certainty() of an array, with the offset of scoring."""
    return np.log(np.maximum(p, math.exp(MIN_CERTAINTY)), where=p > 0, out=np.full(p.shape, MIN_CERTAINTY)) + CERTAINTY_OFFSET


class Rows:
    """All hypotheses a search ever kept, in columns; row 0 is the empty one."""

    COLUMNS = ("before", "code", "permuter", "certainty", "score", "text", "real", "repeat", "fresh", "ends", "states", "prefix", "char")

    def __init__(self) -> None:
        for name, value in zip(self.COLUMNS, (-1, -1, NO_PERM, 0.0, 0.0, 0, -1, False, False, False, None, (), -1)):
            setattr(self, name, [value])
        self.spelled: dict[tuple[int, int], int] = {}

    def add(self, row: tuple) -> int:
        for name, value in zip(self.COLUMNS, row):
            getattr(self, name).append(value)
        return len(self.code) - 1

    def spell(self, text: int, code: int) -> int:
        """The number of a text (codes without blanks and repeats) that goes on by a code; codes 0 at its begin do not count."""
        return self.spelled.setdefault((text, code), len(self.spelled) + 1) if text or code else 0


class Offer(NamedTuple):
    in_words: bool
    follow: int
    before: int
    code: int
    permuter: int
    certainty: float
    repeat: bool = False
    fresh: bool = False  # a word of the lexicon may start after it
    ends: bool = False  # a word may end here
    states: tuple | None = None
    prefix: tuple = ()
    char: int = -1


#: Kinds of a move: it holds its code, is a blank, leaves a character unfinished, ends a space, a letter, or a sign of a script without spaces.
HOLD, SILENT, PART, GAP, LETTER, SIGN = "hold", "silent", "part", "gap", "letter", "sign"
#: Permuters of an offer: a fixed one, that of the hypothesis, of its last character, of the lexicon.
THAT, LAST, GIVEN = "that", "last", "given"


class Rule(NamedTuple):
    """Under which facts a kind of move makes an offer, where the offer goes, and at which price."""

    kinds: tuple[str, ...]
    facts: tuple[str, ...]
    into_words: bool
    permuter: int | str
    dear: bool
    opens: bool = False  # a word of the lexicon may start after it
    spells: bool = False  # the lexicon has accepted it as a letter


#: What hypotheses outside of words, and within words, may do. Facts are methods of Move.
RULES = {
    False: (
        Rule((HOLD, PART), ("bearable",), False, THAT, True),
        Rule((SILENT, GAP, LETTER, SIGN), (), False, TOP_CHOICE_PERM, True),
        Rule((GAP,), ("worded", "sure"), True, NO_PERM, False, opens=True),
        Rule((SIGN,), ("worded",), True, TOP_CHOICE_PERM, True, opens=True),
    ),
    True: (
        Rule((HOLD,), ("sure",), True, THAT, False),
        Rule((SILENT, PART), ("sure",), True, NO_PERM, False),
        Rule((GAP,), ("sure", "whole"), True, LAST, False, opens=True),
        Rule((GAP,), ("sure", "whole"), False, LAST, False),
        Rule((LETTER, SIGN), ("sure", "spelled"), True, GIVEN, False, spells=True),
        Rule((LETTER, SIGN), ("sure", "spelled", "closing"), True, GIVEN, False, opens=True, spells=True),
        Rule((LETTER, SIGN), ("sure", "spelled", "closing"), False, GIVEN, False, spells=True),
    ),
}


class Move:
    """One way for a hypothesis to go on, and the facts that rules ask for; what the lexicon says is asked for once."""

    def __init__(self, beam: Beam, rows: Rows, kind: str, before: int, code: int, certainty: float, char: int):
        self.beam, self.rows, self.kind, self.before, self.code, self.certainty, self.char = beam, rows, kind, before, code, certainty, char
        self.real = rows.real[before]
        self.lexical: tuple[int, tuple, bool] | None = None

    def bearable(self) -> bool:
        return self.code == self.beam.blank or self.certainty * DICT_RATIO >= MIN_CERTAINTY

    def sure(self) -> bool:
        return self.certainty > WORST_DICT

    def worded(self) -> bool:
        return self.beam.lexicon is not None

    def whole(self) -> bool:
        """A word may end before this."""
        return self.real >= 0 and self.rows.ends[self.real]

    def apart(self) -> bool:
        """Two words meet here without the space that both their scripts need."""
        if self.kind == SIGN or self.real < 0 or not self.rows.fresh[self.real]:
            return False
        return self.rows.char[self.real] != SPACE and self.beam.spaced(self.rows.char[self.real])

    def spelled(self) -> bool:
        if self.lexical is None:
            known = self.beam.lexicon.start() if self.real < 0 else self.rows.states[self.real] or ()
            self.lexical = (NO_PERM, (), False) if self.apart() else self.beam.lexicon.step(known, self.char)
        return self.lexical[0] != NO_PERM

    def closing(self) -> bool:
        """In scripts without spaces the next word may start at once."""
        return self.spelled() and self.lexical[2] and not self.beam.all_spaced

    def permuter(self, source: int | str) -> int:
        if source == THAT:
            return self.rows.permuter[self.before]
        if source == LAST:
            return self.rows.permuter[self.real]
        return self.lexical[0] if source == GIVEN else source

    def offer(self, rule: Rule, follow: int, prefix: tuple) -> Offer:
        states = self.beam.lexicon.start() if rule.opens else self.lexical[1] if rule.spells and rule.into_words else None
        certainty = self.certainty * DICT_RATIO if rule.dear else self.certainty
        return Offer(rule.into_words, follow, self.before, self.code, self.permuter(rule.permuter), certainty, self.kind == HOLD, rule.opens, rule.spells and self.lexical[2], states, prefix, self.char)


class Beam:
    """One line's search. codes lists the codes to try, in order; chars maps codes (a number, or a tuple of some) to characters."""

    def __init__(self, blank: int, codes: Sequence[int], chars: dict, lexicon: Lexicon | None = None, spaced=lambda char: True, code_range: int | None = None):
        self.blank, self.codes, self.lexicon, self.spaced = blank, np.array(list(codes)), lexicon, spaced
        self.chars = {c if isinstance(c, tuple) else (c,): i for c, i in chars.items()}
        self.all_spaced = all(spaced(c) for c in chars.values()) if lexicon else True
        #: By prefix, whether each of codes may follow.
        self.after: dict[tuple, np.ndarray] = {}
        place = {c: j for j, c in enumerate(self.codes.tolist())}
        for whole in self.chars:
            for k, code in enumerate(whole):
                if code in place:
                    self.after.setdefault(whole[:k], self.codes == blank)[place[code]] = True
        self.after.setdefault((), self.codes == blank)

    def decode(self, probs: np.ndarray) -> list[Symbol]:
        rows, live = Rows(), [(words, ANY, 0, 0) for words in ((False, True) if self.lexicon else (False,))]
        for row in probs.astype(float):
            live = self.advance(rows, live, row)
        last = self.ending(rows, live) if len(probs) else 0
        path = []
        while last > 0:
            path.append(last)
            last = rows.before[last]
        return self.symbols(rows, path[::-1])

    def advance(self, rows: Rows, live: list[tuple[bool, int, int, int]], row: np.ndarray) -> list[tuple[bool, int, int, int]]:
        """The live hypotheses (in words, what may follow, length of the prefix, row) after a timestep."""
        tier, best = tiers(row, self.blank)
        offers: list[Offer] = []
        openings: dict[int, tuple[float, Offer]] = {}
        first = live[0][-1] == 0 if live else False
        for level in (TOP2,) if first else (TOP2, TOPN, REST):
            for words in (False, True):
                # of twins the one where a new word may start goes first
                held = [(follow, h) for w, follow, _, h in reversed(live) if w == words]
                for move in zip(*self.moves(rows, held, row, tier, level, best)) if held else ():
                    for offer in self.offers(rows, words, *move):
                        if not offer.fresh:
                            offers.append(offer)
                            continue
                        # where words may start, each state keeps one
                        score = rows.score[offer.before] + offer.certainty
                        if offer.follow not in openings or score > openings[offer.follow][0]:
                            openings[offer.follow] = score, offer
            if any(o.follow == ANY for o in offers):
                break
        # a line begins with a word or with text: an opening at its first timestep does not count
        return self.keep(rows, offers + [openings[f][1] for f in sorted(openings) if not first])

    def moves(self, rows: Rows, held: list[tuple[int, int]], row: np.ndarray, tier: np.ndarray, level: int, best: set[int]) -> tuple[np.ndarray, ...]:
        """(row before, code, what may follow, certainty, repeats) of all moves by codes of a tier."""
        follow, at = (np.array(x) for x in zip(*held))
        code, blank = np.array([rows.code[h] for h in at]), self.blank
        alone, joined = certainties(row), certainties(row + row[blank])
        # a hypothesis holds its code, or holds it for the last time and leaves with a blank
        here = (code >= 0) & (tier[code] == level)
        stay, leave = here & (follow != NO_REPEAT), here & (follow == ANY) & (code != blank) & (level == TOP2)
        parts = [(at[stay], code[stay], ANY, alone[code[stay]], True), (at[leave], code[leave], NO_REPEAT, joined[code[leave]], True)]
        # or changes to another code, which may be the first of several and so claim the blank
        tried = np.flatnonzero((tier[self.codes] == level) & ((alone[self.codes] >= MIN_CERTAINTY) | (self.codes == blank)))
        new = self.codes[tried]
        may = np.stack([self.after[rows.prefix[h]] for h in at])[:, tried] & (code[:, None] != new) & (follow != ONLY_REPEAT)[:, None]
        i, j = np.nonzero(may)
        parts.append((at[i], new[j], ANY, alone[new[j]], False))
        if level == TOP2:
            i, j = i[new[j] != blank], j[new[j] != blank]
            claim = joined[new[j]]
            # a change between the two best claims the other's share too
            swap = np.array([follow[a] == ANY and code[a] != blank and {int(code[a]), int(new[b])} == best for a, b in zip(i, j)], bool)
            claim[swap] = certainties(row[new[j[swap]]] + row[blank] + row[code[i[swap]]])
            parts.append((at[i], new[j], ONLY_REPEAT, claim, False))
        sizes = [len(p[0]) for p in parts]
        columns = [np.concatenate([np.broadcast_to(p[c], n) for p, n in zip(parts, sizes)]).tolist() for c in range(5)]
        return tuple(columns)

    def kinds(self, prefix: tuple, code: int, repeat: bool):
        """(kind, character, prefix after it) of what a code may be: one that ends a character may be within a longer one too."""
        if repeat or code == self.blank:
            yield HOLD if repeat else SILENT, -1, prefix
            return
        grown = (*prefix, code)
        char = self.chars.get(grown)
        if char is not None:
            yield GAP if char == SPACE else LETTER if self.spaced(char) else SIGN, char, ()
        if grown in self.after:
            yield PART, -1, grown

    def offers(self, rows: Rows, words: bool, before: int, code: int, follow: int, certainty: float, repeat: bool):
        for kind, char, prefix in self.kinds(rows.prefix[before], code, repeat):
            move = Move(self, rows, kind, before, code, certainty, char)
            for rule in RULES[words]:
                if kind in rule.kinds and all(getattr(move, fact)() for fact in rule.facts):
                    yield move.offer(rule, follow, prefix)

    def keep(self, rows: Rows, offers: list[Offer]) -> list[tuple[bool, int, int, int]]:
        """The BEAM best offers of each state; of offers with the same history the best."""
        score = np.array([rows.score[o.before] + o.certainty for o in offers])
        out, seen, full = [], set(), {}
        for k in np.argsort(-score, kind="stable").tolist():
            o = offers[k]
            still = o.repeat or o.code == self.blank
            text = rows.text[o.before] if still else rows.spell(rows.text[o.before], o.code)
            state = (o.in_words, o.follow, len(o.prefix))
            same = (state, o.code, text, o.permuter, o.fresh, o.prefix)
            if same in seen or full.get(state, 0) == BEAM:
                continue
            seen.add(same)
            full[state] = full.get(state, 0) + 1
            real = rows.real[o.before] if o.char < 0 else len(rows.code)
            out.append((*state, rows.add((o.before, o.code, o.permuter, o.certainty, float(score[k]), text, real, o.repeat, o.fresh, o.ends, o.states, o.prefix, o.char))))
        return sorted(out, key=lambda x: x[:3])

    def ending(self, rows: Rows, live: list[tuple[bool, int, int]]) -> int:
        """The best hypothesis that may end a line: any text, or a whole word or a space in the lexicon."""

        def whole(h: int) -> bool:
            real = rows.real[h]
            return real >= 0 and (rows.ends[real] or rows.char[real] == SPACE)

        ends = [h for words, follow, unfinished, h in live if not unfinished and follow != ONLY_REPEAT and (not words or whole(h))]
        return max(ends, key=lambda h: rows.score[h], default=0)

    def symbols(self, rows: Rows, path: list[int]) -> list[Symbol]:
        """Characters of a path. Every timestep is charged to one of them.

        Blanks are charged to the character after them, at the end to the last one; before a
        space that ends a word, to the word's last character. A space beside unknown text has
        the certainty of its own last timestep.
        """
        code = np.array([rows.code[h] for h in path], int)
        cost = np.array([rows.certainty[h] for h in path])
        silent = code == self.blank
        begins = [not s and not rows.repeat[h] and not rows.prefix[rows.before[h]] for s, h in zip(silent, path)]
        done = np.flatnonzero([rows.char[h] >= 0 for h in path])
        heads = np.flatnonzero(begins)
        if not len(heads):
            return []
        # a character lasts from its first code to the repeats of its last
        chars, permuters = [rows.char[path[t]] for t in done], [rows.permuter[path[t]] for t in done]
        ends = np.array([t + 1 + int(np.argmax(np.append(silent[t + 1 :], True) | np.append(np.isin(np.arange(t + 1, len(code)), heads), True))) for t in done])
        owner = np.minimum(np.searchsorted(heads, np.arange(len(code)), side="left"), len(heads) - 1)
        for i, (t, e) in enumerate(zip(heads, ends)):
            if i and chars[i] == SPACE and permuters[i] != NO_PERM:
                owner[ends[i - 1] : t] = i - 1
            owner[t:e] = i
        out = []
        for i, (t, e) in enumerate(zip(heads, ends)):
            mine = owner == i
            rating = -sum(cost[mine].tolist())
            if chars[i] == SPACE and permuters[i] == NO_PERM:
                mine[: e - 1] = False
            out.append(Symbol(chars[i], int(t), int(e), min([0.0, *cost[mine].tolist()]), rating))
        return out
