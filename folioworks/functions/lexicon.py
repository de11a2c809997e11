"""Word graphs: packed edge records, lookups, and the automaton that walks words through
punctuation, word and number graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np

#: Edge flags above the letter bits, the wildcard id, "no edge".
LAST, BACKWARD, WORD_END, FLAG_BITS = 1, 2, 4, 3
WILDCARD, NO_EDGE = 0, -1
#: Character property bits and permuter ranks (larger is better).
ALPHA, LOWER, UPPER, DIGIT, PUNCTUATION = 1, 2, 4, 8, 16
NO_PERM, PUNC_PERM, TOP_CHOICE_PERM, NUMBER_PERM, SYSTEM_PERM = 0, 1, 2, 6, 8
PUNC, WORD, NUMBER = 0, 1, 2
RANK = {PUNC: PUNC_PERM, WORD: SYSTEM_PERM, NUMBER: NUMBER_PERM}
#: Scripts that write no spaces between words.
UNSPACED = ("Han", "Thai", "Hangul", "Hiragana", "Katakana")


class Graph:
    """A word graph. A node is the position of its first edge; node 0 is the root, next 0 means none."""

    def __init__(self, letters: Sequence[int], following: Sequence[int], ends: Sequence[bool], last: Sequence[bool]):
        self.letters, self.following = np.asarray(letters, np.int64), np.asarray(following, np.int64)
        self.ends, self.last = np.asarray(ends, bool), np.asarray(last, bool)
        self._first: dict[tuple[int, int, bool], int] = {}
        node = 0
        for e in range(len(self.letters)):
            for need_end in (False, True):
                if not need_end or self.ends[e]:
                    self._first.setdefault((node, int(self.letters[e]), need_end), e)
            if self.last[e]:
                node = e + 1

    def edge(self, node: int, letter: int, word_end: bool = False) -> int:
        """The first edge of a node with a letter (and a word's end, if asked for), or NO_EDGE."""
        return self._first.get((node, letter, word_end), NO_EDGE)

    def after(self, edge: int) -> int:
        """The node behind an edge, the root before any edge, NO_EDGE where all words end."""
        if edge == NO_EDGE:
            return 0
        return int(self.following[edge]) or NO_EDGE

    def _walk(self, word: Sequence[int], word_end: bool) -> bool:
        node = 0
        for i, letter in enumerate(word):
            final = i == len(word) - 1
            e = self.edge(node, letter, final and word_end)
            if e == NO_EDGE:
                return False
            node = self.after(e)
            if node == NO_EDGE and not final:
                return False
        return True

    def contains(self, word: Sequence[int]) -> bool:
        return bool(word) and self._walk(word, True)

    def has_prefix(self, word: Sequence[int]) -> bool:
        return self._walk(word, False)


def flag_shift(size: int) -> int:
    """Bits of a letter field: as many as the charset's size has."""
    return int(size).bit_length()


def pack_edges(size: int, edges: Iterable[tuple[int, int, bool, bool]]) -> list[int]:
    """Records from (letter, next, word end, last)."""
    s = flag_shift(size)
    return [letter | (LAST * last | WORD_END * end) << s | following << (s + FLAG_BITS) for letter, following, end, last in edges]


def unpack_edges(size: int, records: Sequence[int]) -> Graph:
    s = flag_shift(size)
    r = np.asarray(records, np.uint64)
    letters, flags, following = r & np.uint64((1 << s) - 1), r >> np.uint64(s) & np.uint64(7), r >> np.uint64(s + FLAG_BITS)
    if (flags & np.uint64(BACKWARD)).any() or (letters >= size).any() or (following >= len(r)).any():
        raise ValueError("word graph has a backward edge, or a letter or node out of range")
    return Graph(letters.astype(np.int64), following.astype(np.int64), (flags & np.uint64(WORD_END)) != 0, (flags & np.uint64(LAST)) != 0)


def build_edges(words: Iterable[Sequence[int]]) -> list[tuple[int, int, bool, bool]]:
    """(letter, next, word end, last) of a prefix tree, nodes breadth first."""
    tree: dict = {}
    for word in words:
        at = tree
        for i, letter in enumerate(word):
            entry = at.setdefault(letter, [False, {}])
            entry[0] |= i == len(word) - 1
            at = entry[1]
    order, start, i, edges = [tree], {id(tree): 0}, 0, 0
    while i < len(order):
        start[id(order[i])] = edges
        edges += len(order[i])
        order += [c for _, (_, c) in sorted(order[i].items()) if c]
        i += 1
    out = []
    for node in order:
        items = sorted(node.items())
        out += [(letter, start[id(c)] if c else 0, end, j == len(items) - 1) for j, (letter, (end, c)) in enumerate(items)]
    return out


#: Kinds of a state: before the core, inside it, in the punctuation after it.
LEAD, CORE, TAIL = 0, 1, 2


class State(NamedTuple):
    """Where a hypothesis stands. Edges are NO_EDGE before the first letter, wrap is BARE without punctuation around."""

    kind: int
    core: int = -1
    at: int = NO_EDGE
    wrap: int = NO_EDGE


BARE = -2


class Lexicon:
    """Words and numbers, bare or as the wildcard of a punctuation pattern, as an automaton with a rule table.

    A transition is (state, graph that accepted the letter, may a word end here). What a state
    does on a letter never changes, so transitions are kept once found.
    """

    def __init__(self, size: int, properties: Callable[[int], int], punc: Graph | None, word: Graph | None, number: Graph | None):
        self.size, self.properties = size, properties
        self.graphs = {k: g for k, g in ((PUNC, punc), (WORD, word), (NUMBER, number)) if g is not None}
        self.cores = [k for k in (WORD, NUMBER) if k in self.graphs]
        self.known: dict[tuple[State, int], list[tuple[State, int, bool]]] = {}

    def start(self) -> tuple[State, ...]:
        punc = self.graphs.get(PUNC)
        bare = tuple(State(CORE, k, NO_EDGE, BARE) for k in self.cores)
        if punc is None:
            return bare
        # a pattern of the wildcard alone already lets bare words through
        return (State(LEAD),) if punc.edge(0, WILDCARD, True) != NO_EDGE else (State(LEAD), *bare)

    def _symbol(self, core: int, letter: int) -> int:
        """In the number graph all digits are the wildcard."""
        return WILDCARD if core == NUMBER and self.properties(letter) & DIGIT else letter

    def _mark(self, wrap: int, letter: int) -> int:
        """The punctuation edge that a letter takes after an edge."""
        punc = self.graphs.get(PUNC)
        return NO_EDGE if punc is None or wrap == BARE else punc.edge(punc.after(wrap), letter)

    def _enter(self, s: State, letter: int):
        gate = self._mark(s.wrap, WILDCARD)
        for k in self.cores if gate != NO_EDGE else ():
            first = self.graphs[k].edge(0, self._symbol(k, letter))
            if first != NO_EDGE:
                yield State(CORE, k, first, gate), k, bool(self.graphs[k].ends[first] and self.graphs[PUNC].ends[gate])

    def _lead(self, s: State, letter: int):
        mark = self._mark(s.wrap, letter)
        if mark != NO_EDGE:
            yield State(LEAD, wrap=mark), PUNC, bool(self.graphs[PUNC].ends[mark])

    def _spell(self, s: State, letter: int):
        core = self.graphs[s.core]
        following = core.edge(core.after(s.at), self._symbol(s.core, letter))
        if following != NO_EDGE:
            yield s._replace(at=following), s.core, bool(core.ends[following] and (s.wrap == BARE or self.graphs[PUNC].ends[s.wrap]))

    def _close(self, s: State, letter: int):
        if s.at != NO_EDGE and self.graphs[s.core].ends[s.at]:
            mark = self._mark(s.wrap, letter)
            if mark != NO_EDGE:
                yield State(TAIL, s.core, s.at, mark), s.core, bool(self.graphs[PUNC].ends[mark])

    #: What each kind of state may do.
    RULES = {LEAD: (_enter, _lead), CORE: (_close, _spell), TAIL: (_close,)}

    def transitions(self, s: State, letter: int) -> list[tuple[State, int, bool]]:
        if (s, letter) not in self.known:
            self.known[s, letter] = [move for rule in self.RULES[s.kind] for move in rule(self, s, letter)]
        return self.known[s, letter]

    def step(self, states: Iterable[State], letter: int) -> tuple[int, tuple[State, ...], bool]:
        """(permuter, states after the letter, whether a word may end there); NO_PERM if nothing accepts it."""
        if not 0 < letter < self.size:  # the wildcard is no letter
            return NO_PERM, (), False
        moves = [move for s in states for move in self.transitions(s, letter)]
        rank = max((RANK[kind] for _, kind, _ in moves), default=NO_PERM)
        return rank, tuple(dict.fromkeys(s for s, _, _ in moves)), any(ends for _, _, ends in moves)

    def classify(self, letters: Sequence[int]) -> tuple[int, bool]:
        """(permuter, whether it may end) of a whole word; (NO_PERM, False) if a letter is refused."""
        rank, states, ends = NO_PERM, self.start(), False
        for letter in letters:
            now, states, ends = self.step(states, letter)
            if now == NO_PERM:
                return NO_PERM, False
            # punctuation after a core keeps the core's permuter
            rank = rank if now == PUNC_PERM and rank != NO_PERM else now
        return rank, ends

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def spaced(script: str | None) -> bool:
    return script not in UNSPACED
