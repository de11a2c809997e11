"""Array kernels of network layers, inference only.

A tensor is a float32 array [y, x, feature]; sums run in float64 and are stored as float32
after every layer and inside recurrences. All layers are pure functions: random fill comes
from a generator that is made anew for every line, so results do not depend on the order
in which lines are processed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

f32 = np.float32

#: Activation tables of 4096 samples at 1/256, cell state limit, softmax limit.
TABLE_SIZE, TABLE_SCALE = 4096, 256
STATE_LIMIT, SOFTMAX_LIMIT = 100.0, 86.0

_X = np.arange(TABLE_SIZE) / TABLE_SCALE
TANH, LOGISTIC = np.tanh(_X), 1 / (1 + np.exp(-_X))


class Fill:
    """Linear congruential generator for off-image inputs (64 bits, upper 31 used)."""

    #: Multiplier and increment.
    A, C = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed & (2**64 - 1)
        self.next()

    def next(self) -> int:
        self.state = (self.state * self.A + self.C) & (2**64 - 1)
        return self.state >> 33

    def signed(self, n: int, limit: float = 1.0) -> np.ndarray:
        """n draws in [-limit, limit], both ends included."""
        return np.array([limit * 2.0 * self.next() / 2147483647.0 - limit for _ in range(n)]).astype(f32)


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.abs(x) * TABLE_SCALE
    i = np.minimum(at, TABLE_SIZE - 2).astype(int)
    return np.where(at >= TABLE_SIZE - 1, 1.0, table[i] + (table[i + 1] - table[i]) * (at - i))


def tanh(x: np.ndarray) -> np.ndarray:
    y = _lookup(TANH, x)
    return np.where(x < 0, -y, y)


def logistic(x: np.ndarray) -> np.ndarray:
    y = _lookup(LOGISTIC, x)
    return np.where(x < 0, 1 - y, y)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(x - x.max(-1, keepdims=True), -SOFTMAX_LIMIT, 0))
    return e / e.sum(-1, keepdims=True)


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "Linear": lambda x: x,
    "Tanh": tanh,
    "Logistic": logistic,
    "Relu": lambda x: np.maximum(x, 0),
    "Softmax": softmax,
    "PosClip": lambda x: np.clip(x, 0, 1),
    "SymClip": lambda x: np.clip(x, -1, 1),
}


def affine(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """weights [out, in + 1] with the bias last; products are added from left to right."""
    total = np.zeros((*x.shape[:-1], len(weights)))
    for j in range(x.shape[-1]):
        total = total + x[..., j, None].astype(float) * weights[:, j]
    return total + weights[:, -1]


@dataclass
class Layer:
    """A runnable layer; kind decides which fields count."""

    kind: str
    name: str = ""
    inputs: int = 0
    outputs: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    children: list[Layer] = field(default_factory=list)
    half: tuple[int, int] = (0, 0)
    scale: tuple[int, int] = (1, 1)
    summary: bool = False
    seed: int = 0

    def forward(self, x: np.ndarray, fill: Fill, tap: Callable[[str, np.ndarray], None] | None = None) -> np.ndarray:
        if self.kind not in ("Series", "Parallel", "Input", "XReversed", "YReversed", "XYTranspose") and x.shape[2] != self.inputs:
            raise ValueError(f"layer {self.name!r} takes {self.inputs} features, not {x.shape[2]}")
        out = getattr(self, f"_{self.kind.lower()}")(x, fill, tap)
        if tap and self.kind != "Input":
            tap(self.name, out)
        return out

    def _input(self, x, fill, tap):
        return x

    def _series(self, x, fill, tap):
        for c in self.children:
            x = c.forward(x, fill, tap)
        return x

    def _parallel(self, x, fill, tap):
        parts = [c.forward(x, fill, tap) for c in self.children]
        if len({p.shape[:2] for p in parts}) > 1:
            raise ValueError(f"the parts of {self.name!r} differ in size")
        return np.concatenate(parts, axis=2)

    def _turned(self, turn, x, fill, tap):
        return np.ascontiguousarray(turn(self.children[0].forward(np.ascontiguousarray(turn(x)), fill, tap)))

    def _xreversed(self, x, fill, tap):
        return self._turned(lambda v: v[:, ::-1], x, fill, tap)

    def _yreversed(self, x, fill, tap):
        return self._turned(lambda v: v[::-1], x, fill, tap)

    def _xytranspose(self, x, fill, tap):
        return self._turned(lambda v: v.swapaxes(0, 1), x, fill, tap)

    def _fullyconnected(self, x, fill, tap):
        return ACTIVATIONS[self.name_of_activation](affine(self.weights[0], x)).astype(f32)

    name_of_activation: str = "Linear"

    def _convolve(self, x, fill, tap):
        return convolve(x, *self.half, fill)

    def _maxpool(self, x, fill, tap):
        return windows(x, *self.scale).max(axis=(1, 3))

    def _reconfig(self, x, fill, tap):
        v = windows(x, *self.scale)  # oy, dy, ox, dx, feature
        h, ys, w, xs, n = v.shape
        return v.transpose(0, 2, 3, 1, 4).reshape(h, w, xs * ys * n)

    def _lstm(self, x, fill, tap):
        return lstm(x, self.weights, self.summary)


def windows(x: np.ndarray, xs: int, ys: int) -> np.ndarray:
    """[oy, dy, ox, dx, feature] of whole windows; what is left over at the ends is dropped."""
    h, w = x.shape[0] // ys, x.shape[1] // xs
    return x[: h * ys, : w * xs].reshape(h, ys, w, xs, x.shape[2])


def convolve(x: np.ndarray, half_x: int, half_y: int, fill: Fill) -> np.ndarray:
    """Stacks each position's neighbourhood: by dx, then dy, then feature. Off-image inputs are drawn.

    Draws go by position in raster order and by column of the neighbourhood; a column beyond
    the image takes one draw for each of its inputs.
    """
    h, w, n = x.shape
    ny, nx = 2 * half_y + 1, 2 * half_x + 1
    padded = np.pad(x, ((half_y, half_y), (half_x, half_x), (0, 0)))
    view = np.lib.stride_tricks.sliding_window_view(padded, (ny, nx), axis=(0, 1))  # y, x, n, dy, dx
    out = np.ascontiguousarray(view.transpose(0, 1, 4, 3, 2)).astype(f32)  # y, x, dx, dy, n
    ys, xs = np.arange(h)[:, None] + np.arange(-half_y, half_y + 1), np.arange(w)[:, None] + np.arange(-half_x, half_x + 1)
    off = ((ys < 0) | (ys >= h))[:, None, None, :] | ((xs < 0) | (xs >= w))[None, :, :, None]
    at = np.flatnonzero(off.ravel())  # raster order, then dx, then dy: the order of the draws
    out.reshape(-1, n)[at] = fill.signed(len(at) * n).reshape(-1, n)
    return out.reshape(h, w, nx * ny * n)


def lstm(x: np.ndarray, gates: list[np.ndarray], summary: bool = False, states: list | None = None) -> np.ndarray:
    """One-dimensional LSTM along x; every row starts anew. gates: cell input, input, forget, output."""
    h, w, n = x.shape
    size = len(gates[0])
    if any(g.shape != (size, n + size + 1) for g in gates):
        raise ValueError("gate matrices do not fit the inputs and states")
    out = np.zeros((h, w, size), f32)
    # rows are independent sequences: all of them advance together
    state, last = np.zeros((h, size)), np.zeros((h, size))
    for t in range(w):
        source = np.concatenate((x[:, t], last.astype(f32)), axis=1)
        cell = tanh(affine(gates[0], source))
        into, keep, show = (logistic(affine(g, source)) for g in gates[1:])
        state = np.clip(state * keep + cell * into, -STATE_LIMIT, STATE_LIMIT)
        last = tanh(state) * show
        out[:, t] = last
    if states is not None:
        states.append(state)
    return out[:, -1:] if summary else out


def lstm_2d(x: np.ndarray, gates: list[np.ndarray]) -> np.ndarray:
    """Two-dimensional LSTM over images (n, h, w, features), along diagonals; the fifth gate weighs the state above."""
    n, h, w, k = x.shape
    size = len(gates[0])
    if any(g.shape != (size, k + 2 * size + 1) for g in gates):
        raise ValueError("gate matrices do not fit the inputs and states")
    # a row above and a column to the left, of zeros
    state, out = np.zeros((n, h + 1, w + 1, size)), np.zeros((n, h + 1, w + 1, size), f32)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        j = d - y
        source = np.concatenate((x[:, y, j], out[:, y + 1, j], out[:, y, j + 1]), axis=-1)
        cell = tanh(affine(gates[0], source))
        into, keep, show, above = (logistic(affine(g, source)) for g in gates[1:])
        now = np.clip(state[:, y + 1, j] * keep + state[:, y, j + 1] * above + cell * into, -STATE_LIMIT, STATE_LIMIT)
        state[:, y + 1, j + 1], out[:, y + 1, j + 1] = now, tanh(now) * show
    return out[:, 1:, 1:]


def x_scale(layer: Layer) -> int:
    """By how much a graph narrows its input: pooling's own, a series' product, other plumbing's first child."""
    if layer.kind in ("Maxpool", "Reconfig"):
        return layer.scale[0]
    if layer.kind == "Series":
        return int(np.prod([x_scale(c) for c in layer.children]))
    return x_scale(layer.children[0]) if layer.children else 1


def stats(values: Iterable[float]) -> tuple[float, float, float]:
    """(min, max, mean), zeros for nothing."""
    v = np.asarray(list(values), float)
    return (float(v.min()), float(v.max()), float(v.mean())) if len(v) else (0.0, 0.0, 0.0)
