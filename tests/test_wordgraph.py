"""Minimal graphs and classification of words against the automaton and the textbook definition."""

from itertools import product

import numpy as np
import pytest

from folioworks.functions import lexicon
from folioworks.operators import lexical, wordgraph


def rows(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def plain_states(words):
    """The sets of endings of all prefixes."""
    begun = {w[:n] for w in words for n in range(len(w))}
    return {frozenset(w[len(p) :] for w in words if w.startswith(p) and w != p) for p in begun}


@pytest.mark.parametrize("seed", range(3))
def test_minimal_graph_has_one_state_for_each_set_of_endings(spark, seed):
    rnd = np.random.RandomState(seed)
    words = {"".join(rnd.choice(list("abc"), rnd.randint(1, 6))) for _ in range(40)}
    edges = wordgraph.minimal_graph(rows(spark, [*words, *sorted(words)[:5], "", None])).collect()
    assert len({e.node for e in edges}) == len(plain_states(words))
    assert len(edges) == len({(e.node, e.letter) for e in edges}) == sum(len({x[0] for x in s}) for s in plain_states(words))
    assert {e.node for e in edges if e.last} == {e.node for e in edges} and sum(e.last for e in edges) == len({e.node for e in edges})
    step, spelled, open_ = {(e.node, e.letter): e for e in edges}, set(), [("", "")]
    while open_:
        word, node = open_.pop()
        for letter in "abc":
            if e := step.get((node, letter)):
                spelled |= {word + letter} if e.eow else set()
                open_ += [(word + letter, e.next)] if e.next is not None else []
    assert spelled == words


def test_walks_accept_the_lexicon_and_its_beginnings(spark):
    words = ["ab", "abc", "bc", "cab", "cabbage"]
    asked = ["", *("".join(w) for n in range(1, 5) for w in product("abc", repeat=n)), "cabbage", "cabbages", "x" * 5000]
    got = {r.word: (r.contains, r.prefix) for r in wordgraph.walk(rows(spark, [*asked, "ab", None]), wordgraph.minimal_graph(rows(spark, words))).collect()}
    begun = {w[:n] for w in words for n in range(len(w) + 1)}
    assert got == {w: (w in words, w in begun) for w in asked} | {None: (False, False)}
    empty = rows(spark, [])
    assert wordgraph.minimal_graph(empty).count() == 0 and wordgraph.walk(empty, wordgraph.minimal_graph(empty)).count() == 0
    assert [(r.contains, r.prefix) for r in wordgraph.walk(rows(spark, ["a"]), wordgraph.minimal_graph(empty)).collect()] == [(False, False)]


@pytest.mark.parametrize("seed", range(4))
def test_classification_is_that_of_the_automaton(spark, seed):
    """All words of up to five letters; brackets that are letters of words too, numbers, patterns with and without the bare word."""
    rnd, letters, wild = np.random.RandomState(seed), list("ab(.17"), "\0"
    words = {"".join(rnd.choice(list("ab("), rnd.randint(1, 4))) for _ in range(5)}
    patterns = [[f"({wild}.", f"{wild}.", "(."], [f"(({wild}", f"({wild}..", "(", wild], None, [f"({wild}.", f".{wild}", "((", wild]][seed]
    numbers = [["0", "00", "0.0"], ["0"], None, ["0.", "(00"]][seed]
    number = {c: i + 1 for i, c in enumerate(letters)}
    code = lambda w, digit=lambda c: False: [lexicon.WILDCARD if c == wild or digit(c) else number[c] for c in w]
    build = lambda ws: lexicon.Graph(*zip(*lexicon.build_edges(ws))) if ws else None
    lex = lexicon.Lexicon(len(letters) + 1, lambda i: lexicon.DIGIT if letters[i - 1].isdigit() else 0, build([code(p) for p in patterns or ()]), build([code(w) for w in sorted(words)]), build([code(w.replace("0", "1"), str.isdigit) for w in numbers or ()]))
    asked = ["".join(w) for n in range(1, 6) for w in product(letters, repeat=n)]
    got = {r.word: (r.permuter, r.valid_end) for r in lexical.classify(rows(spark, [*asked, "", "ax", None]), rows(spark, [*words, None, ""]), letters, patterns, numbers).collect()}
    assert (got.pop(""), got.pop("ax"), got.pop(None)) == ((0, False),) * 3
    want = {w: lex.classify(code(w)) for w in asked}
    wrong = {w: (got[w], want[w]) for w in asked if got[w] != want[w]}
    assert not wrong and len({g[0] for g in want.values()}) >= 2


def test_patterns_of_unknown_letters_are_an_error(spark):
    with pytest.raises(ValueError):
        lexical.classify(rows(spark, ["a"]), rows(spark, ["a"]), ["a"], ["[\0"])
