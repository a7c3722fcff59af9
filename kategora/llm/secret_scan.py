"""Secret scans: all rules in one pass over the bytes of a text.

The rules become one minimal deterministic automaton (``automaton.py``), compiled on the driver
and sent with the task: its size depends on the rules alone. A Python task walks the bytes through
the transition array. Where a rule stops accepting, a match of it ends; the automaton of the
reversed rule then finds where it may have begun, so only matched bytes are read twice. Memory is
one Arrow batch of texts; a lost task is run again from its input split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kategora.llm.automaton import Dfa, compile_rules


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and longest; matches whose ``group`` has fewer than ``least`` characters go.

    With a ``head``, the automaton finds that and Python's own expression the rest of the match: counted
    repeats and long bodies would multiply the automaton's states.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False
    head: str = ""


# The base rules of the contract, in its order.
BASE = [
    Rule(
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        least=6,
        group=2,
        fold=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{6,}", least=24),
]
# Public formats of further keys.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", least=39),
    # The key itself up to its END line; of a key without one, runs of Base64 and the word after them, which may be its last line.
    Rule(
        "pem",
        PEM + r"(?:(?:[\t\n\r\x20-\x2c\x2e-\x7e]|-(?!-))*+-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:[\s\\]*[A-Za-z0-9+/=]{16,})++(?:[\s\\]*[A-Za-z0-9+/=]+)?)?",
        head=PEM,
    ),
]
RULES = [*BASE, *MORE]
SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
MASK = "<secret>"


class Scanner:
    """The compiled rules, as tasks use them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.forward, self.backward = compile_rules([(r.head or r.pattern, r.fold) for r in rules])
        self.groups = [re.compile(r.pattern.encode(), re.I if r.fold else 0) for r in rules]

    def prepare(self) -> Scanner:
        """Lists are indexed faster than arrays; they are made once in each task."""
        self.table, self.marks = list(self.forward.table), list(self.forward.marks)
        return self

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """``(rules, end)``: bit sets of the rules that stop accepting, and where."""
        table, marks, hot = self.table, self.marks, self.forward.hot
        found, before, state = [], 0, self.forward.start
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= hot:
                now = marks[state >> 8]
                if before & ~now:
                    found.append((before & ~now, i))
                before = now
            elif before:
                found.append((before, i))
                before = 0
        if before:
            found.append((before, len(data)))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` in bytes, by start and rule; leftmost, longest, not overlapping within a rule."""
        found: dict[int, dict[int, int]] = {}
        for rules, end in self.ends(data):
            for k in range(len(self.rules)):
                if rules >> k & 1:
                    for start in starts(self.backward[k], data, end):
                        found.setdefault(k, {})[start] = end
        kept = []
        for k, begun in found.items():
            rule, free = self.rules[k], 0
            for start in sorted(begun):
                if start >= free:
                    free = self.groups[k].match(data, start).end() if rule.head else begun[start]
                    if not rule.least or len(self.groups[k].fullmatch(data, start, free)[rule.group]) >= rule.least:
                        kept.append((start, k, free))
        return sorted(kept)


def starts(backward: Dfa, data: bytes, end: int) -> Iterator[int]:
    """Every place from which a match of the rule leads to ``end``."""
    state, hot = backward.start, backward.hot
    for i in range(end - 1, -1, -1):
        state = backward.table[state + data[i]]
        if state >= hot:
            yield i
        elif state == 0:
            return


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or len(data) == len(text := data.decode()):
        return spans
    places, at, count = {}, 0, 0
    for place in sorted({p for a, _, b in spans for p in (a, b)}):
        count += len(data[at:place].decode())
        at = place
        places[place] = count
    return [(places[a], k, places[b]) for a, k, b in spans]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``key, spans`` for every row: kind, start and stop (code points, stop exclusive) in order.

    NULL texts count as empty and have no spans. Matches of one kind never overlap, those of
    different kinds may. NULL keys and repeated rows pass through; other columns are ignored; an
    empty table gives an empty result. Texts are scanned whole.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner.prepare()
        for batch in batches:
            out = []
            for data in texts(batch.column("text")):
                spans = code_points(data, scanner.spans(data))
                out.append([{"kind": kinds[k], "start": a, "stop": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, item)], ["key", "spans"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, spans {SPANS}").select(F.col("key").alias(key), "spans")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mask_secrets(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows as they are, with every secret in ``text`` replaced by ``<secret>``; touching spans become one.

    NULL texts stay NULL; every other column, whatever its name, passes through untouched.
    """
    scanner = Scanner(rules)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner.prepare()
        for batch in batches:
            column = batch.column(text)
            out = [None if x is None else masked(x, scanner.spans(x)).decode() for x in column.cast(pa.binary()).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(out, column.type))

    return docs.mapInArrow(mask, docs.schema)


def masked(data: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    pieces, at = [], 0
    for start, _, stop in spans:
        if start > at or not pieces:
            pieces += [data[at:start], MASK.encode()]
        at = max(at, stop)
    return b"".join([*pieces, data[at:]])


def digest(found: DataFrame, key: str = "doc_id", rules: list[Rule] = RULES, base: list[Rule] = BASE) -> DataFrame:
    """Counts and digests of the spans that ``find_secrets`` returned."""
    names = [r.kind for r in base]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(name) for name in names]
    own = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(key, *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
