"""Secrets in texts, found by one deterministic automaton for all rules.

The rules' regular expressions become one nondeterministic automaton, subset
construction makes it deterministic and partition refinement minimal. Its
transition array has a row for each state and a column for each class of bytes
that no rule tells apart. A text is scanned in one pass over its bytes, which
gives the rules that accept at each of them. Where a rule ceases to accept a match
ends; the automaton of the reversed rule, run back from there to the end of the
match before, gives the leftmost start. These are the leftmost non-overlapping
matches, as each rule accepts from its shortest match on to the end of the longest.
A base match whose value is too short is dropped, but what lies in it is not tried
again; matches that begin in such a one are added beside the base spans, like those
of the other rules. A private key's span begins at the header that the automaton
finds; what belongs to the key behind it is read on from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
from pyspark.sql import DataFrame

from .common import give_back
from .pii import searched

BASE = ("assign", "access", "hex")
#: (kind, expression); literals, classes, groups, |, ?, *, +, {m,} and (?i:...) are understood.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = tuple(k for k, _ in RULES)

#: Characters that an assigned value has at least.
VALUE = 8
#: Behind a header: all up to the END line, if no other line of five dashes comes first ...
_KEY = re.compile(r"(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----")
#: ... or else lines of base64, also with written-out line breaks, and one shorter line right behind them; padding ends them.
_GAP, _STOP = r"(?:\s|\\[nr])++", r"""(?=[ \t]*(?:[\r\n]|\Z|\\[nr]|["'`]))"""
_LINES = re.compile(
    rf"(?:{_GAP}(?:Proc-Type|DEK-Info): [!-\[\]-~]+)*"
    rf"(?:(?<!=){_GAP}(?:[A-Za-z0-9+/]{{40,}}+=*+|[A-Za-z0-9+/]{{16,}}+=*+{_STOP}))+"
    rf"(?:(?<!=)[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/]++=*+{_STOP})?"
)
ASSIGN, PEM = KINDS.index("assign"), KINDS.index("pem")


class _Parser:
    """A regular expression over bytes as a tree: ("set", bytes), ("cat", ...), ("or", ...), ("rep", node, least, unbounded)."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", *options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            node = self.one()
            while (c := self.peek()) and c in "?*+{":
                self.at += 1
                if c == "{":
                    close = self.text.index(",}", self.at)
                    node = ("rep", node, int(self.text[self.at : close]), True)
                    self.at = close + 2
                else:
                    node = ("opt", node) if c == "?" else ("rep", node, int(c == "+"), True)
            parts.append(node)
        return ("cat", *parts)

    def one(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            outer = self.fold
            if self.text.startswith("?i:", self.at):
                self.fold, self.at = True, self.at + 3
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.either()
            self.at, self.fold = self.at + 1, outer
            return node
        if c == "[":
            close = self.text.index("]", self.at)
            body, chars = self.text[self.at : close], set()
            self.at = close + 1
            i = 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == "-":
                    chars |= set(range(ord(body[i]), ord(body[i + 2]) + 1))
                    i += 3
                else:
                    chars.add(ord(body[i]))
                    i += 1
            return ("set", frozenset(chars))
        if c == "\\":
            c, self.at = self.peek(), self.at + 1
        return ("set", frozenset(map(ord, {c.lower(), c.upper()} if self.fold else {c})))


def reverse(node):
    if node[0] == "set":
        return node
    if node[0] == "cat":
        return ("cat", *(reverse(x) for x in node[:0:-1]))
    if node[0] == "or":
        return ("or", *(reverse(x) for x in node[1:]))
    return (node[0], reverse(node[1]), *node[2:])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Adds the node after ``start``; the state it ends in."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            hop = self.state()
            self.empty[start].append(hop)
            self.moves[hop] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1:]:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind in ("or", "opt"):
            for x in node[1:]:
                self.empty[self.add(x, start)].append(end)
            if kind == "opt":
                self.empty[start].append(end)
            return end
        for _ in range(node[2]):
            start = self.add(node[1], start)
        loop = self.state()
        self.empty[start].append(loop)
        self.empty[self.add(node[1], loop)].append(loop)
        self.empty[loop].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """classes: byte -> class. next: state x class -> state; state 0 is the start. accepts: state -> bits of rules."""

    classes: bytes
    next: np.ndarray
    accepts: np.ndarray


def compile_rules(trees: list, anywhere: bool) -> Automaton:
    """Subset construction and minimisation; with ``anywhere`` a match can begin at each byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {nfa.add(t, start): 1 << i for i, t in enumerate(trees)}
    kinds: dict[tuple[int, ...], int] = {}
    sets = [m[0] for m in nfa.moves if m]
    classes = bytes(kinds.setdefault(tuple(i for i, s in enumerate(sets) if b in s), len(kinds)) for b in range(256))
    sample = {c: b for b, c in reversed(list(enumerate(classes)))}
    first = nfa.closure([start])
    begin = first if anywhere else frozenset()
    # NFA state -> class -> the closed set it moves to
    moves = {s: [nfa.closure([m[1]]) if sample[c] in m[0] else None for c in range(len(kinds))] for s, m in enumerate(nfa.moves) if m}
    number, todo, rows, accepts = {first: 0}, [first], [], []
    while len(rows) < len(todo):
        states = todo[len(rows)]
        own = [moves[s] for s in states if s in moves]
        row = []
        for c in range(len(kinds)):
            goal = begin.union(*(m[c] for m in own if m[c]))
            if goal not in number:
                number[goal] = len(todo)
                todo.append(goal)
            row.append(number[goal])
        rows.append(row)
        accepts.append(sum(bit for end, bit in ends.items() if end in states))
    return minimised(classes, np.array(rows, np.int32), np.array(accepts, np.int32))


def minimised(classes: bytes, follow: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States are split by what they accept, then by the parts their transitions lead to, until nothing splits."""
    part = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = part
        for own in follow.T:  # one class of bytes at a time: pairs of numbers are numbered anew
            finer = np.unique(finer * len(part) + part[own], return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    _, sample = np.unique(part, return_index=True)
    order = np.argsort(sample)  # the start state comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return Automaton(classes, rank[part[follow[sample[order]]]].astype(np.int32), accepts[sample[order]])


class Scanner:
    """Automata for ``rules``, built once on the driver and sent to the workers as arrays."""

    def __init__(self, rules=RULES):
        trees = [_Parser(e).either() for _, e in rules]
        self.forward = compile_rules(trees, anywhere=True)
        self.backward = [compile_rules([reverse(t)], anywhere=False) for t in trees]

    def __getstate__(self) -> dict:
        return {"forward": self.forward, "backward": self.backward}

    def rows(self) -> None:
        """Transition rows as lists that refer to each other: a state is its row, whose last entry has the rules that accept there."""
        f = self.forward
        states = [[] for _ in f.next]
        for row, follow, bits in zip(states, f.next.tolist(), f.accepts.tolist(), strict=True):
            row.extend(states[t] for t in follow)
            row.append(bits)
        self.start = states[0]
        self.back = []
        for b in self.backward:
            dead = [(row == s).all() and not b.accepts[s] for s, row in enumerate(b.next)]
            self.back.append((b.classes, b.next.tolist(), b.accepts.tolist(), dead))

    def ends(self, raw: bytes) -> list[tuple[int, int]]:
        """(end, rule) of each stretch of bytes behind which the rule accepts, in order. One pass over the bytes for all rules."""
        if not hasattr(self, "start"):
            self.rows()
        states = accumulate(raw.translate(self.forward.classes), getitem, initial=self.start)
        bits = bytes(map(itemgetter(-1), states))
        if not bits.strip(b"\0"):
            return []
        now = np.frombuffer(bits + b"\0", np.uint8)
        stops = now[:-1] & ~now[1:]
        return [(int(at), k) for at in np.flatnonzero(stops) for k in range(len(self.back)) if stops[at] >> k & 1]

    def leftmost(self, raw: bytes, rule: int, end: int, least: int) -> int:
        """Where the longest match of the rule that ends at ``end`` and begins at ``least`` or later begins; -1 if there is none."""
        classes, follow, accepts, dead = self.back[rule]
        state, start = 0, -1
        for at in range(end - 1, least - 1, -1):
            state = follow[state][classes[raw[at]]]
            if accepts[state]:
                start = at
            elif dead[state]:
                break
        return start

    def matches(self, raw: bytes) -> list[tuple[int, int, int, bool]]:
        """(start, rule, end, whether it is one of the leftmost non-overlapping matches of its rule), bytes."""
        out, done = [], [0] * len(self.backward)
        for end, k in self.ends(raw):
            start = self.leftmost(raw, k, end, done[k])
            own = start >= 0
            if not own:  # it begins in the match before
                start = self.leftmost(raw, k, end, 0)
            else:
                done[k] = end
            out.append((start, k, end, own))
        return out


@cache
def scanner_of(rules=RULES) -> Scanner:
    """Built once for a process."""
    return Scanner(rules)


def value_size(raw: bytes, start: int, end: int) -> int:
    """Of an assignment's value, in bytes: what follows the first sign of assignment, blanks and a quote."""
    at = start
    while raw[at] not in b":=":
        at += 1
    at += 1
    while raw[at] == 32:
        at += 1
    return end - at - (raw[at] in b"\"'")


def key_end(text: str, header_end: int) -> int:
    """Where the private key ends whose header ends at ``header_end``."""
    m = _KEY.match(text, header_end) or _LINES.match(text, header_end)
    return m.end() if m else header_end


def _in_code_points(text: str, raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offset -> code point offset."""
    if text.isascii():
        return {n: n for n in offsets}
    out, at, points = {}, 0, 0
    for n in sorted(offsets):
        points += len(raw[at:n].decode("utf-8", "surrogatepass"))
        out[n], at = points, n
    return out


def find(text: str | None, scanner: Scanner) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with what the automaton finds beside them (same kind: outside; other kinds: all)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    found = [m for m in scanner.matches(raw) if m[1] != ASSIGN or value_size(raw, m[0], m[2]) >= VALUE]
    if not found:
        return [], []
    at = _in_code_points(text, raw, [n for a, _, b, _ in found for n in (a, b)])
    base = sorted((at[a], k, at[b]) for a, k, b, own in found if own and KINDS[k] in BASE)
    more, taken = [], [0] * len(KINDS)  # matches of a rule come in the order of their ends
    for a, k, b, own in found:
        if own and KINDS[k] in BASE:
            taken[k] = b
        elif KINDS[k] not in BASE or a >= taken[k]:
            more.append((at[a], k, key_end(text, at[b]) if k == PEM else at[b]))
    return base, sorted(base + more)


def secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) in code points.

    A null text counts as empty and has no spans. Rows that repeat are each
    scanned, a null doc_id stays null, an empty table gives an empty result, other
    columns are ignored.
    """
    scanner = scanner or scanner_of()
    return searched(docs, KINDS, lambda: lambda text: find(text, scanner))


def redacted(docs: DataFrame, scanner: Scanner | None = None, label: str = "[{kind}]") -> DataFrame:
    """``docs`` with each secret (overlapping spans as one) replaced by its kind's label; other columns stay, n_chars follows if it is there."""
    scanner = scanner or scanner_of()
    schema, has_size = docs.schema, "n_chars" in docs.columns

    def clean(text: str | None) -> str | None:
        _, spans = find(text, scanner)
        if not spans:
            return text
        merged: list[list[int]] = []
        for a, k, b in spans:
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([a, k, b])
        for a, k, b in reversed(merged):
            text = text[:a] + label.format(kind=KINDS[k]) + text[b:]
        return text

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [clean(t) for t in texts]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if has_size:
                kept = zip(texts, new, batch.column("n_chars").to_pylist(), strict=True)
                columns["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in kept], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], schema=batch.schema)
        texts = new = columns = kept = None
        give_back()

    return docs.mapInArrow(run, schema)
