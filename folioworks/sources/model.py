"""Model files: a container of typed components, read into plain tables.

Parsers work on bytes and raise ValueError on anything that does not fit exactly. The
DataFrame source reads files with Spark's binaryFile reader and parses in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, tensor

#: Names of component types by number.
COMPONENTS = {
    0: "lang_config", 1: "unicharset", 2: "ambigs", 3: "inttemp", 4: "pffmtable", 5: "normproto", 6: "punc_dawg", 7: "system_dawg", 8: "number_dawg", 9: "freq_dawg",
    13: "shapetable", 14: "bigram_dawg", 15: "unambig_dawg", 16: "params_model", 17: "lstm", 18: "lstm-punc-dawg", 19: "lstm-word-dawg", 20: "lstm-number-dawg", 21: "lstm-unicharset", 22: "lstm-recoder", 23: "version",
}
LSTM, PUNC_GRAPH, WORD_GRAPH, NUMBER_GRAPH, CHARSET, RECODER, VERSION = 17, 18, 19, 20, 21, 22, 23
TYPES = 24
#: Layer types by number.
LAYERS = [
    "Invalid", "Input", "Convolve", "Maxpool", "Parallel", "Replicated", "ParBidiLSTM", "DepParUDLSTM", "Par2dLSTM", "Series", "Reconfig", "RTLReversed", "TTBReversed", "XYTranspose",
    "LSTM", "SummLSTM", "Logistic", "LinLogistic", "LinTanh", "Tanh", "Relu", "Linear", "Softmax", "SoftmaxNoCTC", "LSTMSoftmax", "LSTMBinarySoftmax", "TensorFlow",
]
#: How the names of the format are grouped: plumbing, one matrix with an activation, LSTM.
PLUMBING = {"Series": "Series", "Parallel": "Parallel", "Replicated": "Parallel", "ParBidiLSTM": "Parallel", "DepParUDLSTM": "Parallel", "Par2dLSTM": "Parallel", "RTLReversed": "XReversed", "TTBReversed": "YReversed", "XYTranspose": "XYTranspose"}
DENSE = {"Logistic": "Logistic", "LinLogistic": "PosClip", "LinTanh": "SymClip", "Tanh": "Tanh", "Relu": "Relu", "Linear": "Linear", "Softmax": "Softmax", "SoftmaxNoCTC": "Softmax"}
RECURRENT = ("LSTM", "SummLSTM", "LSTMSoftmax", "LSTMBinarySoftmax")
GATES = ("CI", "GI", "GF1", "GO", "GFS")
#: Limits and flags.
MAX_STRING, MAX_STACK, MAX_DIM, MAX_CODE, MAX_ENTRIES, MAX_CHARS, MAX_EDGES, GRAPH_MAGIC = 50_000_000, 10_000, 65_535, 9, 1000, 1_000_000, 50_000_000, 42
MODE_DOUBLE, MODE_INT8, TRAINING_ON, FLAG_RATES, INT_MODE, COMPRESSED = 128, 1, 1, 64, 1, 64


class Reader:
    """Bounds-checked reads; swap reverses the bytes of items wider than one."""

    def __init__(self, data: bytes, swap: bool = False):
        self.data, self.at, self.order = memoryview(data), 0, ">" if swap else "<"

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def bytes(self, n: int) -> bytes:
        if not 0 <= n <= self.left:
            raise ValueError(f"{n} bytes wanted at {self.at}, {self.left} left")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def one(self, code: str):
        """One item by its struct code: b B h H i I q Q f d."""
        return struct.unpack(self.order + code, self.bytes(struct.calcsize("=" + code)))[0]

    def array(self, code: str, n: int) -> np.ndarray:
        kind = np.dtype(self.order + code)
        return np.frombuffer(self.bytes(n * kind.itemsize), kind).astype(kind.newbyteorder("="))

    def string(self) -> str:
        n = self.one("I")
        if n > MAX_STRING:
            raise ValueError(f"a string of {n} bytes")
        return self.bytes(n).decode("utf-8", "surrogateescape")

    def end(self) -> None:
        if self.left:
            raise ValueError(f"{self.left} bytes are left over")


def reversed_bytes(data: bytes, width: int) -> bytes:
    """Items of a width with their bytes in reverse."""
    return np.frombuffer(data, np.uint8).reshape(-1, width)[:, ::-1].tobytes()


def type_name(number: int) -> str:
    return COMPONENTS.get(number, f"type({number})")


@dataclass
class Container:
    entries: dict[int, bytes]
    swapped: bool = False

    @property
    def present(self) -> list[int]:
        return sorted(self.entries)

    @property
    def version(self) -> str:
        return self.entries.get(VERSION, b"").rstrip(b"\0\n").decode()


def parse_container(data: bytes) -> Container:
    n = Reader(data).one("I")
    swapped = n > MAX_ENTRIES
    r = Reader(data, swapped)
    n = r.one("I")
    if n > MAX_ENTRIES:
        raise ValueError(f"{n} components")
    offsets = r.array("i8", n)
    known = offsets[offsets >= 0]
    if (known > len(data)).any():
        raise ValueError("a component begins after the file's end")
    out = {}
    for i, begin in enumerate(offsets):
        if begin < 0:
            continue
        later = offsets[i + 1 :][offsets[i + 1 :] >= 0]
        end = int(later[0]) if len(later) else len(data)
        if end < begin:
            raise ValueError(f"component {i} ends before it begins")
        if i < TYPES:
            out[i] = bytes(data[begin:end])
    return Container(out, swapped)


def build_container(entries: dict[int, bytes], swap: bool = False) -> bytes:
    order, n = ">" if swap else "<", TYPES
    at, offsets, body = 4 + 8 * n, [], b""
    for i in range(n):
        offsets.append(at + len(body) if i in entries else -1)
        body += entries.get(i, b"")
    return struct.pack(f"{order}I{n}q", n, *offsets) + body


# -- charset, recoder, graphs -------------------------------------------------


@dataclass(frozen=True)
class Character:
    text: str
    normed: str
    script: str
    properties: int


def parse_character(line: str) -> Character:
    fields = line.partition("\t")[0].split()
    if len(fields) < 3:
        raise ValueError(f"fewer than three fields in {line!r}")
    text = " " if fields[0] == "NULL" else fields[0]
    rest = fields[3:] if "," in fields[2] else fields[2:]
    if not rest:
        raise ValueError(f"no script in {line!r}")
    return Character(text, rest[4] if len(rest) == 5 else text, rest[0], int(fields[1], 16))


def parse_charset(data: bytes) -> list[Character]:
    lines = data.decode("utf-8", "surrogateescape").split("\n")
    n = int(lines[0].strip()) if lines[0].strip().lstrip("+-").isdigit() else 0
    if not 0 < n <= MAX_CHARS or len(lines) < n + 1:
        raise ValueError(f"charset declares {lines[0].strip()!r} entries and has {len(lines) - 1} lines")
    return [parse_character(x.rstrip("\r")) for x in lines[1 : n + 1]]


def parse_recoder(data: bytes, swap: bool = False) -> list[list[int]]:
    r = Reader(data, swap)
    n = r.one("I")
    if n > r.left // 5:
        raise ValueError(f"{n} recoder entries in {r.left} bytes")
    codes = []
    for _ in range(n):
        r.one("b")
        size = r.one("I")
        if size > MAX_CODE:
            raise ValueError(f"a code of length {size}")
        codes.append(r.array("i4", size).tolist())
        if any(c < 0 for c in codes[-1]):
            raise ValueError("a negative code")
    r.end()
    if not codes or codes[0][:1] != [0]:
        raise ValueError("the space does not stand for code 0")
    return codes


def build_recoder(codes: list[list[int]], swap: bool = False) -> bytes:
    o = ">" if swap else "<"
    return struct.pack(o + "I", len(codes)) + b"".join(struct.pack(f"{o}bI{len(c)}i", 1, len(c), *c) for c in codes)


def parse_graph(data: bytes, swap: bool = False) -> tuple[int, list[int]]:
    """(charset size, edge records), checked."""
    r = Reader(data, swap)
    if r.one("h") != GRAPH_MAGIC:
        raise ValueError("not a word graph")
    size, n = r.one("I"), r.one("I")
    if not 0 < size < 2**31 or not 0 < n <= MAX_EDGES or n > r.left // 8:
        raise ValueError(f"{n} edges over {size} characters")
    records = r.array("u8", n).tolist()
    r.end()
    lexicon.unpack_edges(size, records)
    return size, records


def build_graph(size: int, edges: list[tuple[int, int, bool, bool]], swap: bool = False) -> bytes:
    o = ">" if swap else "<"
    return struct.pack(o + "hII", GRAPH_MAGIC, size, len(edges)) + struct.pack(f"{o}{len(edges)}Q", *lexicon.pack_edges(size, edges))


# -- network -----------------------------------------------------------------


@dataclass
class LayerFile:
    """A layer as the file has it."""

    type: str
    name: str
    inputs: int
    outputs: int
    num_weights: int
    flags: int = 0
    matrices: list[np.ndarray] = field(default_factory=list)
    children: list[LayerFile] = field(default_factory=list)
    pair: tuple[int, int] = (0, 0)
    shape: tuple[int, ...] = ()
    na: int = 0

    def walk(self, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], LayerFile]]:
        yield path, self
        for i, c in enumerate(self.children):
            yield from c.walk((*path, i))

    @property
    def own_weights(self) -> int:
        return sum(m.size for m in self.matrices) + sum(c.num_weights for c in self.children)


@dataclass
class Network:
    root: LayerFile
    spec: str
    training_flags: int
    training_iteration: int
    sample_iteration: int
    null_char: int
    rates: tuple[float, float, float]


def _matrix(r: Reader) -> np.ndarray:
    mode = r.one("B")
    if not mode & MODE_DOUBLE or mode & MODE_INT8:
        raise ValueError(f"weights of mode {mode} are not plain float64")
    rows, cols = r.one("i"), r.one("i")
    if not (0 <= rows <= MAX_DIM and 0 <= cols <= MAX_DIM):
        raise ValueError(f"a matrix of {rows} x {cols}")
    return r.array("f8", 1 + rows * cols)[1:].reshape(rows, cols)


def _layer(r: Reader) -> LayerFile:
    tag = r.one("b")
    kind = r.string() if tag == 0 else LAYERS[tag] if 0 < tag < len(LAYERS) else ""
    if kind not in LAYERS:
        raise ValueError(f"layer type {kind or tag!r}")
    training = r.one("b")
    r.one("b")
    flags, inputs, outputs, weights = (r.one("i") for _ in range(4))
    out = LayerFile(kind, r.string(), inputs, outputs, weights, flags)
    if min(inputs, outputs, weights) < 0 or training == TRAINING_ON:
        raise ValueError(f"layer {out.name!r} has negative sizes or is a training dump")
    if kind in PLUMBING:
        n = r.one("I")
        if n > MAX_STACK:
            raise ValueError(f"a stack of {n} layers")
        out.children = [_layer(r) for _ in range(n)]
        if flags & FLAG_RATES:
            r.array("f4", r.one("I"))
    elif kind in DENSE:
        out.matrices = [_matrix(r)]
    elif kind in RECURRENT:
        out.na = r.one("i")
        out.matrices = [_matrix(r)]
        extra = {"LSTMSoftmax": outputs, "LSTMBinarySoftmax": max(0, outputs - 1).bit_length()}.get(kind, 0)
        two_d = out.na - extra == inputs + 2 * len(out.matrices[0])
        out.matrices += [_matrix(r) for _ in GATES[1 : 5 if two_d else 4]]
        if kind in RECURRENT[2:]:
            out.children = [_layer(r)]
    elif kind in ("Convolve", "Maxpool", "Reconfig"):
        out.pair = r.one("i"), r.one("i")
    elif kind == "Input":
        out.shape = tuple(r.one("i") for _ in range(5))
    else:
        raise ValueError(f"layer type {kind} cannot be read")
    if out.own_weights != weights:
        raise ValueError(f"layer {out.name!r} declares {weights} weights and has {out.own_weights}")
    return out


def parse_network(data: bytes, swap: bool = False) -> Network:
    r = Reader(data, swap)
    root, spec = _layer(r), r.string()
    numbers = [r.one("i") for _ in range(4)]
    out = Network(root, spec, *numbers, tuple(r.one("f") for _ in range(3)))
    r.end()
    if out.training_flags & INT_MODE or not out.training_flags & COMPRESSED or not 0 <= out.null_char < root.outputs:
        raise ValueError("the network is of int8 weights, without a recoder, or its blank is out of range")
    return out


def build_layer(x: LayerFile, swap: bool = False) -> bytes:
    o = ">" if swap else "<"
    text = lambda s: struct.pack(o + "I", len(s.encode())) + s.encode()
    matrix = lambda m: struct.pack(f"{o}Bii{1 + m.size}d", MODE_DOUBLE, *m.shape, 0.0, *m.ravel())
    out = struct.pack("b", 0) + text(x.type) + struct.pack(f"{o}bbiiii", 2, 0, x.flags, x.inputs, x.outputs, x.num_weights) + text(x.name)
    if x.type in PLUMBING:
        out += struct.pack(o + "I", len(x.children)) + b"".join(build_layer(c, swap) for c in x.children)
    elif x.type in RECURRENT:
        out += struct.pack(o + "i", x.na)
    out += b"".join(map(matrix, x.matrices))
    if x.type in ("Convolve", "Maxpool", "Reconfig"):
        out += struct.pack(o + "ii", *x.pair)
    return out + (struct.pack(o + "5i", *x.shape) if x.type == "Input" else b"")


def build_network(n: Network, swap: bool = False) -> bytes:
    o = ">" if swap else "<"
    spec = n.spec.encode()
    return build_layer(n.root, swap) + struct.pack(f"{o}I{len(spec)}s4i3f", len(spec), spec, n.training_flags, n.training_iteration, n.sample_iteration, n.null_char, *n.rates)


# -- whole models -----------------------------------------------------------


@dataclass
class Model:
    network: Network
    charset: list[Character]
    codes: list[list[int]]
    graphs: dict[int, tuple[int, list[int]]]
    version: str = ""

    @property
    def code_range(self) -> int:
        return max((max(c) for c in self.codes if c), default=-1) + 1

    @property
    def decoder(self) -> dict[tuple[int, ...], int]:
        """Code to character; of characters that share a code the highest."""
        return {tuple(c): i for i, c in enumerate(self.codes) if 0 < len(c) <= MAX_CODE}

    def checks(self) -> dict[str, bool]:
        soft = [x for _, x in self.network.root.walk() if x.type.startswith("Softmax")]
        return {
            "recoder size": len(self.codes) == len(self.charset),
            "one softmax": len(soft) == 1,
            "softmax outputs": bool(soft) and soft[0].outputs == self.code_range,
            "root outputs": bool(soft) and self.network.root.outputs == soft[0].outputs,
            "blank is last": self.network.null_char == self.code_range - 1,
            "graph sizes": all(size == len(self.charset) for size, _ in self.graphs.values()),
        }

    def lexicon(self) -> lexicon.Lexicon | None:
        if not self.graphs:
            return None
        g = [lexicon.unpack_edges(*self.graphs[k]) if k in self.graphs else None for k in (PUNC_GRAPH, WORD_GRAPH, NUMBER_GRAPH)]
        return lexicon.Lexicon(len(self.charset), lambda i: self.charset[i].properties if 0 <= i < len(self.charset) else 0, *g)


def load_model(data: bytes) -> Model:
    c = parse_container(data)
    for need in (LSTM, CHARSET, RECODER):
        if need not in c.entries:
            raise ValueError(f"no component {type_name(need)}")
    graphs = {k: parse_graph(c.entries[k], c.swapped) for k in (PUNC_GRAPH, WORD_GRAPH, NUMBER_GRAPH) if k in c.entries}
    out = Model(parse_network(c.entries[LSTM], c.swapped), parse_charset(c.entries[CHARSET]), parse_recoder(c.entries[RECODER], c.swapped), graphs, c.version)
    if bad := [k for k, ok in out.checks().items() if not ok]:
        raise ValueError(f"model fails: {', '.join(bad)}")
    return out


def runnable(x: LayerFile) -> tensor.Layer:
    """A layer of the file as one that computes; raises for what has no float form here."""
    common = {"name": x.name, "inputs": x.inputs, "outputs": x.outputs}
    if x.type in PLUMBING:
        if not x.children:
            raise ValueError(f"layer {x.name!r} is empty")
        return tensor.Layer(PLUMBING[x.type], children=[runnable(c) for c in x.children], **common)
    if x.type in DENSE:
        if [m.shape for m in x.matrices] != [(x.outputs, x.inputs + 1)]:
            raise ValueError(f"the matrix of {x.name!r} does not fit")
        return tensor.Layer("FullyConnected", weights=x.matrices, name_of_activation=DENSE[x.type], **common)
    if x.type in RECURRENT[:2]:
        if len(x.matrices) != 4 or x.na != x.inputs + len(x.matrices[0]):
            raise ValueError(f"layer {x.name!r} is not a one-dimensional LSTM")
        return tensor.Layer("LSTM", weights=x.matrices, summary=x.type == "SummLSTM", **common)
    if x.type == "Convolve":
        return tensor.Layer("Convolve", half=x.pair, **common)
    if x.type in ("Maxpool", "Reconfig"):
        return tensor.Layer(x.type, scale=x.pair, **common)
    if x.type == "Input":
        return tensor.Layer("Input", **common)
    raise ValueError(f"layer type {x.type} cannot run")


def input_shape(x: LayerFile) -> tuple[int, ...] | None:
    return next((c.shape for _, c in x.walk() if c.shape), None)


# -- DataFrames ---------------------------------------------------------------


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, name, size, bytes) of the components of all container files under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, t, type_name(t), len(v), v) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t, v in sorted(parse_container(d).entries.items())]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()))], ["path", "type", "name", "size", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, type int, name string, size long, bytes binary")


def layer_rows(root: LayerFile) -> list[tuple]:
    """(layer_id, parent_id, ord, type, name, ni, no, num_weights, own_weights): ids in depth-first order."""
    at = {p: i for i, (p, _) in enumerate(root.walk())}
    return [(at[p], at[p[:-1]] if p else None, p[-1] if p else 0, x.type, x.name, x.inputs, x.outputs, x.num_weights, sum(m.size for m in x.matrices)) for p, x in root.walk()]


LAYER_SCHEMA = "layer_id int, parent_id int, ord int, type string, name string, ni int, no int, num_weights long, own_weights long"


def graph_rows(model: Model) -> Iterator[tuple]:
    """(dawg, node, edge, unichar_id, next, eow, last) of all word graphs."""
    for kind, (size, records) in model.graphs.items():
        g, node = lexicon.unpack_edges(size, records), 0
        for e in range(len(records)):
            yield type_name(kind), node, e, int(g.letters[e]), int(g.following[e]), bool(g.ends[e]), bool(g.last[e])
            node = e + 1 if g.last[e] else node


def start_rows(model: Model) -> Iterator[tuple]:
    lex = model.lexicon()
    yield from (tuple(map(int, s)) for s in (lex.start() if lex else ()))


def built_rows(model: Model) -> Iterator[tuple]:
    """What the layers become: kind, sizes and how much each narrows its input."""
    for path, x in model.network.root.walk():
        r = runnable(x)
        yield ".".join(map(str, path)) or "root", r.kind, r.inputs, r.outputs, tensor.x_scale(r)


#: The tables of a model file: their columns, and their rows from a loaded model.
TABLES = {
    "layers": (LAYER_SCHEMA, lambda m: layer_rows(m.network.root)),
    "weights": ("layer_id int, gate int, row int, values array<double>", lambda m: ((i, k, r, row.tolist()) for i, (_, x) in enumerate(m.network.root.walk()) for k, w in enumerate(x.matrices) for r, row in enumerate(w))),
    "charset": ("id int, text string, normed string, script string, properties int", lambda m: ((i, c.text, c.normed, c.script, c.properties) for i, c in enumerate(m.charset))),
    "recoder": ("unichar_id int, code array<int>", lambda m: enumerate(m.codes)),
    "dawg_edges": ("dawg string, node long, edge long, unichar_id int, next long, eow boolean, last boolean", graph_rows),
    "records": ("dawg string, size int, edge long, record long", lambda m: ((type_name(k), size, i, r) for k, (size, records) in m.graphs.items() for i, r in enumerate(records))),
    "model_check": ("invariant string, ok boolean", lambda m: m.checks().items()),
    "start": ("kind int, core int, at int, wrap int", start_rows),
    "built": ("path string, kind string, inputs int, outputs int, x_scale int", built_rows),
}


def rows_of_files(spark: SparkSession, path: str, schema: str, rows: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(file, ...) from the model files under a path: rows are made where a file is read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["file"], b["content"]):
                found = list(rows(bytes(data)))
                for i in range(0, len(found), 10_000):
                    part = pd.DataFrame(found[i : i + 10_000], columns=names)
                    part.insert(0, "file", file)
                    yield part

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    return files.mapInPandas(run, f"file string, {schema}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of TABLES, with the file, of all model files under a path; a file that does not parse is an error."""
    schema, rows = TABLES[name]
    return rows_of_files(spark, path, schema, lambda data: rows(load_model(data)))


def header_rows(data: bytes) -> Iterator[tuple]:
    """(components, bytes, names, swapped, version) of a container."""
    c = parse_container(data)
    yield len(c.present), sum(map(len, c.entries.values())), ",".join(map(type_name, c.present)), c.swapped, c.version


#: What read_values reads in turn: struct codes of whole and real numbers.
VALUE_CODES = dict(i8="b", u8="B", i16="h", i32="i", u32="I", i64="q", f32="f", f64="d")


def read_values(packed: DataFrame, key: str, bytes_: str, swap: str) -> DataFrame:
    """(key, i8, u8, i16, i32, u32, i64, u64, f32, f64, text, reals, left) read in this order from each row's bytes.

    reals is a counted run of float64; u64 is text, as Spark has no such type; left counts unread bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, data, swapped in b.itertuples(index=False):
                r = Reader(bytes(data), bool(swapped))
                got = {n: r.one(c) for n, c in VALUE_CODES.items()}
                out.append({"key": k, **got, "u64": str(r.one("Q")), "text": r.string(), "reals": r.array("f8", r.one("I")).tolist(), "left": r.left})
            yield pd.DataFrame(out, columns=["key", *VALUE_CODES, "u64", "text", "reals", "left"])

    rows = packed.select(F.col(key).cast("long"), bytes_, swap)
    return rows.mapInPandas(run, "key long, i8 int, u8 int, i16 int, i32 int, u32 long, i64 long, f32 double, f64 double, u64 string, text string, reals array<double>, left int")


def write_values(values: dict, swap: bool) -> bytes:
    """What read_values reads."""
    o, text = ">" if swap else "<", values["text"].encode()
    head = b"".join(struct.pack(o + c, values[n]) for n, c in VALUE_CODES.items())
    return head + struct.pack(f"{o}QI{len(text)}s", int(values["u64"]), len(text), text) + struct.pack(f"{o}I{len(values['reals'])}d", len(values["reals"]), *values["reals"])


def describe(data: bytes) -> list[str]:
    """Text report of a model file: components; for a model with a network its header, layer tree with matrix statistics, charset, codes and graphs."""
    c = parse_container(data)
    out = [f"version {c.version}", f"bytes swapped {c.swapped}", f"components {len(c.present)}"]
    out += [f"  {type_name(t)} {len(c.entries[t])}" for t in c.present]
    if LSTM not in c.entries:
        return [*out, "no network"]
    model = load_model(data)
    n = model.network
    out += [f"spec {n.spec}", f"flags {n.training_flags} iteration {n.training_iteration} sample {n.sample_iteration} blank {n.null_char}", "rates " + " ".join(f"{x:.9g}" for x in n.rates)]
    for path, x in n.root.walk():
        pad = "  " * len(path)
        extra = f" na={x.na}" if x.na else f" pair={x.pair}" if any(x.pair) else f" shape={x.shape}" if x.shape else ""
        out.append(f"{pad}{x.type} {x.name!r} ni={x.inputs} no={x.outputs}{extra} weights={x.num_weights}")
        for i, m in enumerate(x.matrices):
            low, high, mean = tensor.stats(m.ravel())
            label = GATES[i] if x.type in RECURRENT else str(i)
            out.append(f"{pad}    {label} {m.shape[0]}x{m.shape[1]} min={low:.9g} max={high:.9g} mean={mean:.9g}")
    out.append(f"charset {len(model.charset)}")
    out += [f"  {i} {c.text!r} {c.properties:x} {c.script}" + (f" normed {c.normed!r}" if c.normed != c.text else "") for i, c in enumerate(model.charset)]
    out.append(f"recoder {len(model.codes)} range {model.code_range} longest {max(map(len, model.codes), default=0)}")
    out += [f"  {i} {code}" + (" BLANK" if code == [n.null_char] else "") for i, code in enumerate(model.codes)]
    out.append("graphs")
    for kind in (PUNC_GRAPH, WORD_GRAPH, NUMBER_GRAPH):
        out.append(f"  {type_name(kind)} " + (f"{len(model.graphs[kind][1])} edges of {model.graphs[kind][0]} characters" if kind in model.graphs else "absent"))
    return out
