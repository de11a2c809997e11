"""Expectations on single images, tensors, decoders and automata; no Spark."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.functions import ctc, lexicon, raster, tensor

bitmaps = st.integers(0, 2**32 - 1).map(lambda s: (np.random.RandomState(s).rand(*np.random.RandomState(s).randint(1, 14, 2)) < 0.5).astype(np.uint8))


def test_fractiles():
    v = np.array([10, 10, 20, 20])
    assert (raster.fractile(v, 0.25), raster.fractile(v, 0.75), raster.fractile(v, 0)) == (10.5, 20.5, 10.5)
    assert raster.fractile(np.array([]), 0.5) == 0
    assert (raster.fractile(np.array([0]), 0.5), raster.fractile(np.array([255]), 0.5)) == (1, 256)


def test_flat_line():
    assert raster.black_white(np.full((40, 36), 128, np.uint8)) == (1, 256)


def test_bricks():
    one = np.zeros((12, 12), np.uint8)
    one[5, 5] = 1
    y, x = np.nonzero(raster.dilate(one, 4, 2))
    assert (x.min(), x.max(), y.min(), y.max()) == (3, 6, 4, 5)
    full = raster.erode(np.ones((20, 20), np.uint8), 3, 3)
    assert full.sum() == 18 * 18 and not full[0].any() and not full[:, -1].any()
    blobs = np.zeros((30, 30), np.uint8)
    blobs[3:12, 3:12] = blobs[20:22, 20:22] = 1
    assert raster.opening(blobs, 5, 5).sum() == 81
    pair = np.zeros((15, 24), np.uint8)
    pair[5:10, 5:10] = pair[5:10, 12:17] = 1
    assert len(raster.components(raster.closing(pair, 5, 1), 4)) == 1
    with pytest.raises(ValueError):
        raster.dilate(one, 0, 1)


def test_diagonals():
    eye = np.eye(5, dtype=np.uint8)
    assert len(raster.components(eye, 4)) == 5 and raster.components(eye, 8) == [(0, 0, 5, 5, 5)]


@settings(max_examples=40, deadline=None)
@given(bitmaps)
def test_components_and_seeds(bits):
    mark, h, w = raster.label(bits, 4), *bits.shape
    for y in range(h):
        for x in range(w):
            for v, u in ((y, x + 1), (y + 1, x)):
                if v < h and u < w and bits[y, x] and bits[v, u]:
                    assert mark[y, x] == mark[v, u]
    seed = np.zeros_like(bits)
    seed[0, 0] = 1
    filled = raster.seed_fill(seed, bits, 4)
    assert np.array_equal(filled > 0, (mark == mark[0, 0]) & (bits > 0)) if bits[0, 0] else not filled.any()


@settings(max_examples=40, deadline=None)
@given(bitmaps)
def test_distance(bits):
    d, h, w = raster.city_block(bits), *bits.shape
    paper = [(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and bits[y, x])]
    for y, x in np.argwhere(bits):
        assert d[y, x] == min(abs(y - a) + abs(x - b) for a, b in paper)


def test_distance_saturates():
    assert raster.city_block(np.ones((601, 601), np.uint8))[300, 300] == 255


@settings(max_examples=30, deadline=None)
@given(bitmaps, st.sampled_from(sorted(raster.RASTER_OPS)), st.tuples(*[st.integers(-6, 10)] * 4), st.tuples(st.integers(-6, 6), st.integers(-6, 6)))
def test_raster_op(dst, op, rect, at):
    src = np.roll(dst, 1)
    got, (x0, y0, w, h) = raster.raster_op(dst, rect, op, src, at), rect
    code = raster.RASTER_OPS[op]
    for y in range(dst.shape[0]):
        for x in range(dst.shape[1]):
            sx, sy = x - x0 + at[0], y - y0 + at[1]
            inside = x0 <= x < x0 + w and y0 <= y < y0 + h
            real = 0 <= sx < src.shape[1] and 0 <= sy < src.shape[0]
            if inside and (real or op in ("clear", "set")):
                s = src[sy, sx] if real else 0
                assert got[y, x] == code >> (2 * int(s) + int(dst[y, x])) & 1
            else:
                assert got[y, x] == dst[y, x]


def test_scaling():
    a = np.random.RandomState(0).randint(0, 256, (36, 50)).astype(np.uint8)
    assert np.array_equal(raster.scale_gray(a, 1.0), a)
    assert raster.scale_gray(a, 2.0).shape == (72, 100) and raster.scale_gray(a, 4.0).shape == (144, 200)
    assert np.array_equal(raster.enlarge(a, 2)[::2, ::2], a)
    assert raster.halve(np.array([[1, 2, 9], [3, 5, 9]], np.uint8)).tolist() == [[2]]
    assert raster.scale_gray(a, 0.01).shape == (1, 1)
    flat = np.full((40, 40), 77, np.uint8)
    for f in (0.03, 0.3, 0.5, 0.9, 1.3, 3.0):
        assert (raster.scale_gray(flat, f) == 77).all()
    with pytest.raises(ValueError):
        raster.scale_gray(a, 0)


def test_small_scales_are_means_of_boxes():
    a = np.random.RandomState(1).randint(0, 256, (230, 310)).astype(np.uint8)
    got = raster.scale_gray(a, 0.0125)  # boxes of 80 pixels, 4 x 3 of them
    assert got.shape == (3, 4)
    for (y, x), v in np.ndenumerate(got):
        top, left = min(230 * y // 3, 230 - 80), min(310 * x // 4, 310 - 80)
        assert v == int(np.float32(a[top : top + 80, left : left + 80].sum(dtype=np.int64)) * (np.float32(1) / np.float32(6400)))


def test_area_average_by_hand():
    a = np.arange(100, dtype=np.uint8).reshape(10, 10)
    out = raster.area_average(a, 4, 4)  # 40 sixteenths each: two whole pixels and a half
    assert out[0, 0] == (sum(16 * 16 * int(a[y, x]) for y in (0, 1) for x in (0, 1)) + 8 * 16 * sum(int(a[y, 2]) + int(a[2, y]) for y in (0, 1)) + 64 * int(a[2, 2]) + 128) // 1600


def test_skew():
    page = np.zeros((300, 400), np.uint8)
    page[40:260:20, 40:360] = 1
    page[41:261:20, 40:360] = 1
    for degrees in (-2.5, 0.7, 3.87):
        assert abs(math.degrees(raster.skew_angle(raster.rotate(page, math.radians(degrees)))) - degrees) < 0.1
    assert raster.skew_angle(np.zeros((5, 5), np.uint8)) == 0


def test_convolution_layout():
    ramp = np.arange(9, dtype=np.float32).reshape(3, 3, 1)
    out = tensor.convolve(ramp, 1, 1, tensor.Fill(1))
    assert [out[1, 1, (dx + 1) * 3 + dy + 1] for dy in (-1, 0, 1) for dx in (-1, 0, 1)] == list(range(9))
    first = tensor.Fill(1).signed(3)  # the first place's left column is all beyond the image
    assert np.array_equal(out[0, 0, :3], first)


def test_lstm_equations():
    gates = [np.array([[1.0, 0.0, 0.0]]) for _ in range(4)]
    out = tensor.lstm(np.array([[[0.5], [0.25]]], np.float32), gates)
    state = 0.0
    for x, got in zip((0.5, 0.25), out[0, :, 0]):
        g = float(tensor.logistic(np.array(x)))
        state = state * g + float(tensor.tanh(np.array(x))) * g
        assert abs(got - float(tensor.tanh(np.array(state))) * g) < 1e-6
    rows = tensor.lstm(np.array([[[0.5], [0.25]]] * 2, np.float32), gates, True)
    assert rows.shape == (2, 1, 1) and rows[0, 0, 0] == rows[1, 0, 0] == out[0, 1, 0]
    states: list = []
    tensor.lstm(np.ones((1, 300, 1), np.float32), [np.array([[9.0, 0, 9.0]])] * 4, states=states)
    assert states[0][0, 0] == 100.0
    with pytest.raises(ValueError):
        tensor.lstm(np.ones((1, 2, 2), np.float32), gates)


def test_tables():
    x = np.linspace(-8, 8, 4001)
    assert np.abs(tensor.tanh(x) - np.tanh(x)).max() < 2e-6
    assert tensor.tanh(np.array([20.0, -20.0])).tolist() == [1, -1] and tensor.logistic(np.array([20.0, -20.0])).tolist() == [1, 0]
    assert np.allclose(tensor.softmax(np.array([1.0, 2.0, 3.0])).sum(), 1)


def test_fill_is_pure():
    assert np.array_equal(tensor.Fill(7).signed(5), tensor.Fill(7).signed(5)) and np.abs(tensor.Fill(7).signed(1000)).max() <= 1


def test_certainties():
    assert ctc.certainty(1.0) == 0 and ctc.certainty(0.5) == math.log(0.5) and ctc.certainty(0.0) == -20
    assert [round(ctc.confidence(c), 3) for c in (-0.095, 0, -10)] == [96.675, 100, 0]
    p = np.array([[0.2, 0.3, 0.5], [0.05, 0.9, 0.05], [0.1, 0.8, 0.1], [0.005, 0.005, 0.99]])
    s = ctc.score(p, ctc.greedy(p, 2, {0: 0, 1: 1}))
    each = [math.log(v) - 0.085 for v in (0.5, 0.9, 0.8, 0.99)]
    assert len(s) == 1 and math.isclose(s[0].certainty, min(each)) and math.isclose(s[0].rating, -sum(each))


def test_boundaries_and_words():
    sym = lambda c, a, b, k=0.0: ctc.Symbol(c, a, b, k)
    assert ctc.boundaries([sym(1, 1, 3), sym(2, 6, 7)], 10) == [0, 4, 10]
    assert ctc.boundaries([], 10) == [10] and ctc.boundaries([sym(1, 4, 5)], 10) == [0, 10]
    assert ctc.split_words([sym(3, 0, 1), sym(4, 1, 2), sym(0, 2, 3, -0.9), sym(5, 3, 4), sym(6, 4, 5)]) == [(0, 2, -0.9), (3, 5, -0.9)]
    assert ctc.word_bounds([0, 4, 10], 0, 1, 6.0, (100, 50, 400, 90)) == (100, 50, 124, 90)


def test_beam_merges_blank():
    p = np.array([[0.02, 0.55, 0.03, 0.40], [0.005, 0.98, 0.005, 0.01], [0.005, 0.01, 0.005, 0.98]])
    out = ctc.Beam(3, range(4), {0: 0, 1: 1, 2: 2}).decode(p)
    assert [s.char for s in out] == [1]
    assert (math.log(0.55) - 0.085) * 2.25 < out[0].certainty <= (math.log(0.95) - 0.085) * 2.25 + 1e-9


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_beam_without_lexicon_follows_sharp_scores(seed):
    p = np.full((20, 6), 0.0002)
    p[np.arange(20), np.random.RandomState(seed).randint(0, 6, 20)] = 0.999
    chars = {i: i for i in range(5)}
    assert [s.char for s in ctc.Beam(5, range(6), chars).decode(p)] == [s.char for s in ctc.greedy(p, 5, chars)]


def every_text(p, blank):
    """The best score of every text by all ways to spell it: no beam, no ranking, straight from the rules.

    A character's run holds its code; before it leaves, or when it begins, it may count the
    blank's share as its own, which the code at its other end must then keep to.
    """
    cost = lambda x: (ctc.certainty(x) + ctc.CERTAINTY_OFFSET) * ctc.DICT_RATIO
    found: dict = {}

    def go(t, code, follow, text, total):
        if t == len(p):
            if follow != ctc.ONLY_REPEAT:
                found[text] = max(found.get(text, -1e9), total)
            return
        row = p[t]
        best = sorted(range(len(row)), key=lambda c: (-row[c], c))[:2]
        top = {*best, blank}
        if code in top:
            if follow != ctc.NO_REPEAT:
                go(t + 1, code, ctc.ANY, text, total + cost(row[code]))
            if follow == ctc.ANY and code != blank:
                go(t + 1, code, ctc.NO_REPEAT, text, total + cost(row[code] + row[blank]))
        if follow == ctc.ONLY_REPEAT:
            return
        for c in top - {code}:
            more = text if c == blank else (*text, c)
            go(t + 1, c, ctc.ANY, more, total + cost(row[c]))
            if c != blank:
                swap = row[code] if code not in (None, blank) and follow == ctc.ANY and {code, c} == set(best) else 0.0
                go(t + 1, c, ctc.ONLY_REPEAT, more, total + cost(row[c] + row[blank] + swap))

    go(0, None, ctc.ANY, (), 0.0)
    return found


@pytest.mark.parametrize("seed", range(25))
def test_beam_finds_the_best_text_of_short_lines(seed):
    rnd = np.random.RandomState(seed)
    p = rnd.dirichlet(np.full(4, 0.5), rnd.randint(1, 5))
    want = every_text(p, 3)
    text = max(want, key=want.get)
    out = ctc.Beam(3, range(4), {0: 0, 1: 1, 2: 2}).decode(p)
    assert tuple(s.char for s in out) == text
    if out:
        assert -sum(s.rating for s in out) == pytest.approx(want[text])


#: Characters of one to three codes; no character's codes begin another's.
MANY = {(0, 1): 4, (0, 2, 0): 5, (1,): 6, (2, 2): 7}


def every_coding(p, blank, chars):
    """every_text, but a code may begin or go on only as some character's codes do, and a line ends with a whole character."""
    cost = lambda x: (ctc.certainty(x) + ctc.CERTAINTY_OFFSET) * ctc.DICT_RATIO
    begun = {w[:k] for w in chars for k in range(1, len(w) + 1)}
    found: dict = {}

    def go(t, code, follow, part, text, total):
        if t == len(p):
            if follow != ctc.ONLY_REPEAT and not part:
                found[text] = max(found.get(text, -1e9), total)
            return
        row = p[t]
        best = sorted(range(len(row)), key=lambda c: (-row[c], c))[:2]
        top = {*best, blank}
        if code in top:
            if follow != ctc.NO_REPEAT:
                go(t + 1, code, ctc.ANY, part, text, total + cost(row[code]))
            if follow == ctc.ANY and code != blank:
                go(t + 1, code, ctc.NO_REPEAT, part, text, total + cost(row[code] + row[blank]))
        if follow == ctc.ONLY_REPEAT:
            return
        for c in top - {code}:
            if c == blank:
                go(t + 1, c, ctc.ANY, part, text, total + cost(row[c]))
            elif (*part, c) in begun:
                whole = chars.get((*part, c))
                then, more = ((*part, c), text) if whole is None else ((), (*text, whole))
                go(t + 1, c, ctc.ANY, then, more, total + cost(row[c]))
                swap = row[code] if code not in (None, blank) and follow == ctc.ANY and {code, c} == set(best) else 0.0
                go(t + 1, c, ctc.ONLY_REPEAT, then, more, total + cost(row[c] + row[blank] + swap))

    go(0, None, ctc.ANY, (), (), 0.0)
    return found


@pytest.mark.parametrize("seed", range(40))
def test_beam_finds_the_best_text_of_several_codes(seed, monkeypatch):
    monkeypatch.setattr(ctc, "BEAM", 100)  # nothing is pruned
    rnd = np.random.RandomState(seed)
    p = rnd.dirichlet([0.7, 0.7, 0.7, 0.3], rnd.randint(1, 7))
    want = every_coding(p, 3, MANY)
    out = ctc.Beam(3, range(4), MANY).decode(p)
    if not want:
        assert out == []
        return
    text = max(want, key=want.get)
    assert tuple(s.char for s in out) == text
    if out:
        assert -sum(s.rating for s in out) == pytest.approx(want[text])


@pytest.mark.parametrize("seed", range(4))
def test_beam_reads_codes_of_one_to_nine_elements(seed):
    rnd = np.random.RandomState(seed)
    # the first code says how many follow, so no character's codes begin another's
    chars = {(n, *rnd.randint(0, 10, n).tolist()): n for n in range(9)}
    text, path, spans = rnd.randint(0, 9, 12).tolist(), [], []
    of = {i: c for c, i in chars.items()}
    for i in text:
        begin = None
        for c in of[i]:
            if path and path[-1] == c:
                path.append(10)
            begin = len(path) if begin is None else begin
            path += [c] * rnd.randint(1, 3)
        spans.append((begin, len(path)))
        path += [10] * rnd.randint(0, 2)
    p = np.full((len(path), 11), 0.0002)
    p[np.arange(len(path)), path] = 0.998
    out = ctc.Beam(10, range(11), chars).decode(p)
    assert [s.char for s in out] == text
    # a character may claim the blanks beside it, for their share
    assert all(s.start <= a and s.end >= b for s, (a, b) in zip(out, spans)) and all(a.end <= b.start for a, b in zip(out, out[1:]))


def test_beam_reads_words_of_several_codes():
    """A lexicon spells characters, whatever their codes; of two readings close by, the word wins."""
    chars = {(0,): 0, (1, 2): 1, (1, 3): 2, (4,): 3}
    graph = lexicon.Graph(*zip(*lexicon.build_edges([(1, 3), (2, 1)])))
    lex = lexicon.Lexicon(4, lambda i: lexicon.ALPHA, None, graph, None)
    p = np.full((3, 6), 0.001)
    p[0, 1], p[1, 2], p[1, 3], p[2, 4] = 0.99, 0.45, 0.54, 0.99
    assert [s.char for s in ctc.Beam(5, range(6), chars).decode(p)] == [2, 3]
    assert [s.char for s in ctc.Beam(5, range(6), chars, lex).decode(p)] == [1, 3]


@pytest.mark.parametrize("seed", range(10))
def test_automaton_by_enumeration(seed):
    """All words of up to five letters, against patterns with words put in for the wildcard."""
    from itertools import product

    rnd = np.random.RandomState(seed)
    words = {tuple(rnd.randint(1, 4, rnd.randint(1, 4)).tolist()) for _ in range(4)}
    patterns = [(4, None, 5), (None, 4), (5, 5, None)] + [(None,)] * (seed % 2)
    graph = lambda ws: lexicon.Graph(*zip(*lexicon.build_edges(ws)))
    lex = lexicon.Lexicon(6, lambda i: 0, graph([[lexicon.WILDCARD if x is None else x for x in w] for w in patterns]), graph(words), None)
    whole = {tuple(y for x in w for y in (core if x is None else (x,))) for w in patterns for core in words} | words
    begun = {w[:i] for w in whole for i in range(1, len(w) + 1)}
    for n in range(1, 6):
        for w in product(range(1, 6), repeat=n):
            permuter, end = lex.classify(w)
            assert ((permuter != lexicon.NO_PERM), end and permuter != lexicon.PUNC_PERM) == (w in begun, w in whole), w


def test_graphs():
    g = lexicon.Graph([1, 9, 2], [2, 0, 0], [False, False, True], [True, True, True])
    assert g.contains([1, 2]) and not g.contains([1]) and g.has_prefix([1]) and g.has_prefix([]) and not g.contains([]) and not g.contains([1, 2, 2])
    assert [lexicon.flag_shift(n) for n in (1, 63, 64, 112, 128)] == [1, 6, 7, 7, 8]
    words = [[3, 4], [3], [5, 5, 5]]
    edges = lexicon.build_edges(words)
    back = lexicon.unpack_edges(10, lexicon.pack_edges(10, edges))
    assert all(back.contains(w) for w in words) and not back.contains([5, 5]) and back.has_prefix([5, 5])
    with pytest.raises(ValueError):
        lexicon.unpack_edges(10, [12])


def test_automaton():
    number = {c: i + 1 for i, c in enumerate("abc(). 123")}
    code = lambda w: [number[c] for c in w]
    build = lambda ws: lexicon.Graph(*zip(*lexicon.build_edges(ws)))
    wild = lexicon.WILDCARD
    punc = build([[wild], [number["("], wild, number[")"]], [wild, number["."]]])
    lex = lexicon.Lexicon(20, lambda i: lexicon.DIGIT if i >= 8 else 0, punc, build([code("ab"), code("abc")]), build([[wild, wild]]))
    assert lex.classify(code("ab")) == (lexicon.SYSTEM_PERM, True)
    assert lex.classify(code("a")) == (lexicon.SYSTEM_PERM, False)
    assert lex.classify(code("(ab)")) == (lexicon.SYSTEM_PERM, True)
    assert lex.classify(code("(ab")) == (lexicon.SYSTEM_PERM, False)
    assert lex.classify(code("ab.")) == (lexicon.SYSTEM_PERM, True)
    assert lex.classify(code("12")) == (lexicon.NUMBER_PERM, True)
    assert lex.classify(code("ba")) == (lexicon.NO_PERM, False) and lex.classify([wild]) == (lexicon.NO_PERM, False)
