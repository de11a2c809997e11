"""Line images to text: normalise, network, decode in one Arrow stage; a line is a row.

Nothing is shuffled: each row holds a whole line image, the model is broadcast. Every line
gets a fresh fill generator with the model's seed, so a line's result does not depend on the
lines before it or on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ctc, lexicon, raster, tensor
from ..sources import model as files

#: Fixed value: what a model's sample count is multiplied by to seed the fill generator.
SEED = 0x10000001

LINES = "line_id long, width int, height int, pix binary"
WORDS = "array<struct<text:string,x0:int,y0:int,x1:int,y1:int,confidence:double>>"


@dataclass
class Recognizer:
    root: tensor.Layer
    height: int
    x_scale: int
    blank: int
    seed: int
    texts: list[str]
    scripts: list[str]
    codes: list[int]
    chars: dict[tuple[int, ...], int]
    code_range: int
    lexicon: lexicon.Lexicon | None = None

    @staticmethod
    def of(m: files.Model, use_lexicon: bool = True) -> Recognizer:
        shape = files.input_shape(m.network.root)
        if shape is None or shape[1] <= 0 or shape[2] != 0 or shape[3] != 1:
            raise ValueError(f"input shape {shape} is not one gray channel of fixed height and free width")
        if not all(m.codes):
            raise ValueError("a character has no code")
        codes = list(dict.fromkeys(x for c in m.codes for x in c))
        blank = m.network.null_char
        chars = {tuple(c): i for c, i in m.decoder.items() if tuple(c) != (blank,)}
        lex = m.lexicon() if use_lexicon else None
        if lex is not None:
            lex.properties = dict(enumerate(c.properties for c in m.charset)).get
        return Recognizer(files.runnable(m.network.root), shape[1], tensor.x_scale(files.runnable(m.network.root)), blank, m.network.sample_iteration * SEED, [c.text for c in m.charset], [c.script for c in m.charset], codes, chars, m.code_range, lex)

    def normalise(self, image: np.ndarray, fill: tensor.Fill) -> tuple[np.ndarray, float]:
        """([height, width, 1], page pixels per timestep) of a gray line."""
        return normalise(image, self.height, self.x_scale, fill)

    def forward(self, image: np.ndarray, tap=None) -> tuple[np.ndarray, float]:
        """(probabilities [t, code], scale)."""
        fill = tensor.Fill(self.seed)
        x, scale = self.normalise(image, fill)
        out = self.root.forward(x, fill, tap)
        return out.reshape(-1, out.shape[2]), scale

    def beam(self, probs: np.ndarray) -> list[ctc.Symbol]:
        spaced = lambda c: lexicon.spaced(self.scripts[c]) if 0 <= c < len(self.scripts) else True
        return ctc.Beam(self.blank, self.codes, self.chars, self.lexicon, spaced, self.code_range).decode(probs)

    def greedy_text(self, image: np.ndarray) -> str:
        """By best path, which reads characters of one code alone."""
        return "".join(self.texts[s.char] for s in ctc.greedy(self.forward(image)[0], self.blank, {c[0]: i for c, i in self.chars.items() if len(c) == 1}))

    def recognize(self, image: np.ndarray, box: tuple[int, int, int, int] | None = None) -> dict:
        probs, scale = self.forward(image)
        return assemble(self.beam(probs), len(probs), self.texts, scale, box or (0, 0, image.shape[1], image.shape[0]))


def normalise(image: np.ndarray, height: int, x_scale: int, fill: tensor.Fill) -> tuple[np.ndarray, float]:
    """Scaled to a height, stretched by its own black and white, missing places drawn."""
    if not image.size:
        raise ValueError("an empty line image")
    factor = float(np.float32(height) / np.float32(image.shape[0]))
    scaled = raster.scale_gray(image, factor)
    if min(scaled.shape) < x_scale:
        raise ValueError(f"the scaled line is {scaled.shape[1]} x {scaled.shape[0]}, below {x_scale}")
    black, white = map(np.float32, raster.black_white(scaled))
    half = (white - black) / np.float32(2)
    half = half if half > 0 else np.float32(1)
    values = (scaled.astype(np.float32) - black) / half - np.float32(1)
    out = np.empty((height, scaled.shape[1]), np.float32)
    have = min(height, scaled.shape[0])
    out[:have] = values[:have]
    if have < height:
        out[have:] = fill.signed((height - have) * scaled.shape[1]).reshape(height - have, -1)
    return out[:, :, None], x_scale / factor


def assemble(symbols: list[ctc.Symbol], width: int, texts: list[str], scale: float, box: tuple[int, int, int, int]) -> dict:
    """A line's text, confidence and words from its symbols."""
    bounds, found = ctc.boundaries(symbols, width), []
    for first, after, space in ctc.split_words(symbols):
        worst = min([0.0, space, *(s.certainty for s in symbols[first:after])])
        at = ctc.word_bounds(bounds, first, after, scale, box)
        found.append({"text": "".join(texts[s.char] for s in symbols[first:after]), **dict(zip(("x0", "y0", "x1", "y1"), at)), "confidence": ctc.confidence(worst)})
    line = min([100.0, *(w["confidence"] for w in found)]) if found else 0.0
    return {"text": "".join(texts[s.char] for s in symbols), "confidence": line, "words": found}


def recognize_lines(lines: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(line_id, text, confidence, words, error) of lines(line_id, width, height, pix); a line that fails has an error."""
    shared = lines.sparkSession.sparkContext.broadcast(recognizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Recognizer = shared.value
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.struct([("text", pa.string()), *((c, pa.int32()) for c in ("x0", "y0", "x1", "y1")), ("confidence", pa.float64())])), pa.string()]
        for b in batches:
            rows = []
            for i, w, h, pix in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    out = r.recognize(np.frombuffer(pix, np.uint8).reshape(h, w))
                    rows.append((i, out["text"], out["confidence"], out["words"], None))
                except (ValueError, TypeError) as e:
                    rows.append((i, None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["line_id", "text", "confidence", "words", "error"])

    return lines.select("line_id", "width", "height", "pix").mapInArrow(run, f"line_id long, text string, confidence double, words {WORDS}, error string")


def activations(lines: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(line_id, layer, feature, t, value): what every layer but the input puts out."""
    shared = lines.sparkSession.sparkContext.broadcast(recognizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, pix in zip(*(c.to_pylist() for c in b.columns)):
                seen: list[tuple[str, np.ndarray]] = []
                shared.value.forward(np.frombuffer(pix, np.uint8).reshape(h, w), lambda name, out: seen.append((name, out)))
                for name, out in seen:
                    flat = out.reshape(-1, out.shape[2])
                    t, f = np.indices(flat.shape)
                    n = flat.size
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([name] * n), pa.array(f.ravel(), pa.int32()), pa.array(t.ravel(), pa.int32()), pa.array(flat.ravel().astype(float))], ["line_id", "layer", "feature", "t", "value"])

    return lines.select("line_id", "width", "height", "pix").mapInArrow(run, "line_id long, layer string, feature int, t int, value double")


def activation_report(rows: DataFrame) -> DataFrame:
    """(line_id, layer, feature, text): one text line for each feature, values by timestep."""
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: F.format_string("%.9g", s["value"])), " ")
    return rows.groupBy("line_id", "layer", "feature").agg(values.alias("text"))


def confidence_grid(words: DataFrame, width: int, height: int, least: int = 5) -> DataFrame:
    """(page, cell, p10): tenth percentile of the confidences in each of 3 x 3 cells with enough words. An addition."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    third = lambda v, n: F.least(F.lit(2), F.greatest(F.lit(0), F.floor(v * 3 / n)))
    cell = (third(y, height) * 3 + third(x, width)).cast("int")
    return words.groupBy("page", cell.alias("cell")).agg(F.percentile("confidence", 0.1).alias("p10"), F.count("*").alias("n")).where(F.col("n") >= least).select("page", "cell", "p10")
