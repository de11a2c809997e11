"""Operator 2: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, scheme
marks, plus signs, digits and identifier cues in any mix of upper and lower case. From each anchor a deterministic local parser
expands to the left and right, and a validator keeps or drops what it found. Kinds, in order:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds; per kind leftmost and not
  overlapping, a match that fails its validation is dropped as a whole;
* ``account``: the value after a cue such as ``account no:``, ``IBAN`` or ``token =``, with a
  digit and at least 6 characters (an IBAN must pass its check digits);
* ``url``: scheme, ``://`` and an address with a dotted host.

account and url are dropped where they overlap a base span, url where it overlaps an account.

Edge cases: null and empty texts have no span; rows are independent, so repeated rows
repeat their result; texts of any length are read as a whole, in time that grows with their
length; offsets count code points, the end is exclusive; of spans that begin together all base
kinds stay, of added ones the earlier kind; an empty table gives an empty table; other columns
play no part, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
CUES = ("account", "acct", "iban", "customer id", "user id", "member id", "passport", "ssn", "tax id", "token", "api_key", "api key", "apikey", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"\x20?(?:number|no\.?|id|nr\.?|#)?\x20{0,2}[:=#]?\x20{0,2}[\"']?([A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)", re.I)
_IBAN = re.compile(r"[:=]?\x20?([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{4}){2,7}(?:\x20?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"[^\s\"'<>()\[\]{}|\\^`]+")
_HOST = re.compile(r"(?:[^/?#@]*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#]|$)")

_LOWER = {c: c + 32 for c in range(65, 91)}

_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in [("@", "@"), ("://", ":"), ("+", "+"), *((d, "0") for d in "0123456789")]:
            a.add_word(word, (kind, len(word)))
        for cue in CUES:
            a.add_word(cue, ("cue", len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def folded(text: str) -> str:
    """text with its letters A to Z in lower case; every place keeps its character's place."""
    # outside of ASCII only two letters' lower case is longer or falls into ASCII
    return text.translate(_LOWER) if "\u0130" in text or "\u212a" in text else text.lower()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans of a text, by start and then kind."""
    if not text:
        return []
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    email = ip = card = phone = run = end = 0  # where each kind's last match ended
    low = folded(text)
    for last, (kind, length) in automaton().iter(low):
        at = last - length + 1
        if kind == "0":
            fresh = at == 0 or text[at - 1] not in _DIGITS
            if fresh and at >= ip and (m := _IP.match(text, at)):
                ip = m.end()
                if all(map(_octet, m.group().split("."))):
                    base.append((at, 1, ip))
            if at >= card and (fresh or at == card) and (m := _CARD.match(text, at)):
                card = m.end()
                if 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    base.append((at, 2, card))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                base.append((start, 0, email))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    base.append((at, 3, phone))
        elif kind == ":":
            start = at
            while start > 0 and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at:
                if last + 1 >= run:  # addresses that begin in one run of characters end with it
                    run = m.end() if (m := _ADDRESS.match(text, last + 1)) else last + 1
                    end = run
                    while end > last + 1 and text[end - 1] in ".,;:!?":
                        end -= 1
                if last + 1 < end and _HOST.match(text, last + 1, end):
                    more.append((start, 5, end))
        elif not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            cue = low[at : last + 1]
            if cue == "iban" and (m := _IBAN.match(text, last + 1)):
                if _iban(m.group(1)):
                    more.append((m.start(1), 4, m.end(1)))
            elif (m := _VALUE.match(text, last + 1)) and m.start(1) > last + 1 and len(v := m.group(1)) >= 6 and any(c in _DIGITS for c in v):
                more.append((m.start(1), 4, m.end(1)))
    kept = sorted(base)
    for kind in (4, 5):
        free, after = untouched(kept), 0
        for s, k, e in sorted(x for x in more if x[1] == kind):
            if s >= after and free(s, e):
                base.append((s, k, e))
                after = e
        kept = sorted(base)
    return [(KINDS[k], s, e) for s, k, e in kept]


def untouched(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether an interval overlaps none of the spans, which are sorted by start: those that begin before its end must end before its start."""
    starts = [s for s, _, _ in spans]
    ends = [0, *accumulate((e for _, _, e in spans), max)]
    return lambda s, e: ends[bisect_left(starts, e)] <= s


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end, value>>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:int,end:int,value:string>>")
    return out.withColumnRenamed("key", key)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                end, parts = 0, []
                for k, s, e in find(t):
                    if s >= end:
                        parts += [t[end:s], f"[{k}]"]
                        end = e
                out.append(None if t is None else "".join(parts) + t[end:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in KINDS[len(BASE) :]),
    )
