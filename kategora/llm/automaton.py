"""Regular expressions to minimal deterministic automata over bytes.

Understands what secret rules need: literals, ``\\xHH`` and escaped characters, classes, groups,
``|`` and the repeats ``? * + {n} {n,}``. A rule may fold the case of its letters.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

Bytes = frozenset


@dataclass
class Nfa:
    """States are numbers; ``moves`` leads on a set of bytes, ``empty`` on nothing."""

    moves: list[list[tuple[Bytes, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def reach(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def reverse(self) -> Nfa:
        back = Nfa([[] for _ in self.moves], [[] for _ in self.empty])
        for s, out in enumerate(self.moves):
            for chars, to in out:
                back.moves[to].append((chars, s))
        for s, out in enumerate(self.empty):
            for to in out:
                back.empty[to].append(s)
        return back


class Parser:
    """Adds the automaton of one pattern to an ``Nfa``: ``(start, end)``."""

    def __init__(self, nfa: Nfa, pattern: str, fold: bool):
        self.nfa, self.rest, self.fold = nfa, pattern, fold

    def parse(self) -> tuple[int, int]:
        found = self.choice()
        if self.rest:
            raise ValueError(f"cannot read {self.rest!r}")
        return found

    def take(self, n: int = 1) -> str:
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def choice(self) -> tuple[int, int]:
        ways = [self.sequence()]
        while self.rest[:1] == "|":
            self.take()
            ways.append(self.sequence())
        if len(ways) == 1:
            return ways[0]
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in ways:
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.rest and self.rest[0] not in "|)":
            begun = self.rest
            piece = self.atom()
            text = begun[: len(begun) - len(self.rest)]
            end = self.repeated(end, piece, text)
        return start, end

    def repeated(self, end: int, piece: tuple[int, int], text: str) -> int:
        least, most = 1, 1
        if self.rest[:1] in ("?", "*", "+"):
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.take()]
        elif m := re.match(r"\{(\d+)(,?)\}", self.rest):
            self.take(m.end())
            least, most = int(m[1]), None if m[2] else int(m[1])
        empty, copies = self.nfa.empty, 0
        while copies < max(least, 1):
            a, b = piece if copies == 0 else Parser(self.nfa, text, self.fold).parse()
            empty[end].append(a)
            if least == 0:
                empty[a].append(b)
            end, copies = b, copies + 1
        if most is None:
            empty[b].append(a)
        return end

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            inner = self.choice()
            self.take()
            return inner
        chars = self.group() if c == "[" else {self.escape() if c == "\\" else ord(c)}
        if self.fold:
            chars = {ord(x) for v in chars for x in (chr(v).lower(), chr(v).upper())}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.moves[a].append((frozenset(chars), b))
        return a, b

    def escape(self) -> int:
        c = self.take()
        return int(self.take(2), 16) if c == "x" else ord(c)

    def group(self) -> set[int]:
        chars: set[int] = set()
        while self.rest[0] != "]":
            low = high = self.escape() if (c := self.take()) == "\\" else ord(c)
            if self.rest[0] == "-" and self.rest[1] != "]":
                self.take()
                high = self.escape() if (c := self.take()) == "\\" else ord(c)
            chars.update(range(low, high + 1))
        self.take()
        return chars


@dataclass(frozen=True)
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256, as is ``start``.

    ``marks[state]`` is the bit set of rules that accept there; states without marks come first,
    and the first of them, 0, is where nothing can match any more unless the automaton restarts.
    """

    table: array
    marks: array
    start: int

    @property
    def hot(self) -> int:
        """First state (times 256) that accepts."""
        return 256 * sum(m == 0 for m in self.marks)


def determinise(nfa: Nfa, start: frozenset[int], accept: dict[int, int], restart: bool) -> Dfa:
    """Subset construction, then minimisation by refining the partition of states.

    ``restart`` lets a match begin at any byte.
    """
    sets = {chars for out in nfa.moves for chars, _ in out}
    classes: dict[tuple, int] = {}
    of_byte = [classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)]
    sample = [of_byte.index(k) for k in range(len(classes))]
    first = nfa.reach(start)
    numbers, rows, todo = {frozenset(): 0, first: 1}, {}, [frozenset(), first]
    while todo:
        here = todo.pop()
        row = []
        for byte in sample:
            to = {t for s in here for chars, t in nfa.moves[s] if byte in chars}
            there = nfa.reach(to | start if restart else to)
            if there not in numbers:
                numbers[there] = len(numbers)
                todo.append(there)
            row.append(numbers[there])
        rows[numbers[here]] = row
    marks = [0] * len(numbers)
    for states, k in numbers.items():
        for s in states:
            marks[k] |= accept.get(s, 0)
    part = marks
    while True:
        names: dict[tuple, int] = {}
        new = [names.setdefault((part[k], *[part[t] for t in rows[k]]), len(names)) for k in range(len(marks))]
        if len(names) == len(set(part)):
            break
        part = new
    # Number the parts: those without marks first, the dead state before all.
    of_part = {p: k for k, p in reversed(list(enumerate(new)))}
    order = sorted(of_part, key=lambda p: (marks[of_part[p]] != 0, p != new[0], p))
    place = {p: i for i, p in enumerate(order)}
    table = array("i", [0] * (256 * len(order)))
    for p in order:
        row = rows[of_part[p]]
        for byte in range(256):
            table[256 * place[p] + byte] = 256 * place[new[row[of_byte[byte]]]]
    return Dfa(table, array("q", [marks[of_part[p]] for p in order]), 256 * place[new[1]])


def compile_rules(patterns: list[tuple[str, bool]]) -> tuple[Dfa, list[Dfa]]:
    """One forward automaton of all rules, and for each rule one that reads a match backwards."""
    nfa = Nfa()
    ends = [Parser(nfa, p, fold).parse() for p, fold in patterns]
    start = frozenset(a for a, _ in ends)
    forward = determinise(nfa, start, {b: 1 << k for k, (_, b) in enumerate(ends)}, restart=True)
    back = nfa.reverse()
    return forward, [determinise(back, frozenset([b]), {a: 1}, restart=False) for a, b in ends]
