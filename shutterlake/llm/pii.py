"""Personal data in texts: plain patterns, and a semi-Markov conditional random field that adds to them.

The patterns (``base_spans``) fix which spans are always reported. The model
looks at the text around digits and at signs, written out ones too, and on to the
ends of address-like runs there: it scores whole candidate segments with features
of the span as a whole (grammar, checksum, digit count, separators, edges, the word
before), and dynamic programming chooses boundaries and types jointly, around the
base spans, which stay as they are. Spans it finds beside the base ones, such as
telephone numbers without a plus sign or addresses with blanks about the at sign,
are added.

Entities are bounded, each kind by its own measure: an address has at most
``MAX_ADDRESS`` characters, a card 19 digits, a telephone number 15, both in at most
``MAX_GROUPS`` groups, an IP address four. Candidates begin and end at the edges of
groups of digits or beside an at sign only, so their number grows with a text's
length and texts full of numbers cost no more than others.

The weights are fitted by gradient ascent on the conditional log-likelihood
(forward-backward over segments). Its labels are the base spans of at most
``TRAIN_SNIPPETS`` snippets of the table, and rewritten copies of those.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, release

KINDS = ("email", "ip", "card", "phone")
#: Characters of an address, as mail allows; groups of digits of a number; characters between two of them.
MAX_ADDRESS, MAX_GROUPS, MAX_GAP = 254, 8, 5
#: Edges on each side of an at sign at which an address can begin or end, beside the farthest.
EDGES = 24
#: What is trained on: snippets of at most so many characters.
TRAIN_DOCS, TRAIN_SNIPPETS, SNIPPET = 4000, 800, 240
AROUND = 24

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[\[(]at[\])]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]*+")
#: What of an address can follow its at sign.
_BEHIND = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)*+")
_AT = re.compile(r"@|[\[(]at[\])]")
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile("[A-Za-z]+|[0-9]+")
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{3,6}(?:[ .-]?[0-9]{2,6}){2,5}"),
    "phone": re.compile(r"(?:\+|00)?\(?[0-9][0-9 ().-]{7,}[0-9]"),
}
_CUE = re.compile(r"(mail|contact|ip|host|server|card|visa|credit|phone|tel|call|fax|mobile)\W*$", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of each base span, in order."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, last := m.end()))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """The stretches in which a segment can lie: on both sides of digits and at signs AROUND characters, on to the ends of address-like runs."""
    start, end, far = 0, -1, -1
    for m in _TRIGGER.finditer(text):
        low, high = m.start() - AROUND, m.end() + AROUND
        if not m[0].isdigit() and (behind := _BEHIND.match(text, m.end())):
            high = max(high, behind.end())
        if low > end:  # else the stretch goes on
            far = _ADDRESS.match(text, end).end() if end >= 0 else -1
            if low > far:
                if end >= 0:
                    yield start, far
                start = max(0, low)
                while start > far + 1 and text[start - 1] in _LOCAL:
                    start -= 1
        end = max(end, far, high)
    if end >= 0:
        yield start, _ADDRESS.match(text, min(end, len(text))).end()


_SIGNS_OF = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_BLANK = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isdigit()})


def cue(text: str, start: int) -> str:
    """The word right before that announces an entity."""
    m = _CUE.search(text, max(0, start - 16), start)
    return m[1].lower() if m else ""


def features(text: str, start: int, end: int, kind: str, before: str) -> tuple[str, ...] | None:
    """Of the whole span as a segment of that kind, ``before`` being its cue; None where its grammar rules it out."""
    span = text[start:end]
    if not _LOOSE[kind].fullmatch(span):
        return None
    groups = span.translate(_BLANK).split()
    signs = span.translate(_SIGNS_OF)
    out = [f"{kind}:", f"{kind}:seps={''.join(sorted(set(signs)))}", f"{kind}:left={_class(text[start - 1 : start])}", f"{kind}:right={_class(text[end : end + 1])}"]
    if kind == "email":
        out.append(f"email:tld={min(4, len(span) - 1 - max(span.rfind('.'), span.rfind(')'), span.rfind(']'), span.rfind(' ')))}")
    elif kind == "ip":
        out.append(f"ip:octets={all(int(p) <= 255 for p in groups)}")
    elif kind == "card":
        digits = "".join(groups)
        out.append(f"card:luhn={luhn(digits)},{13 <= len(digits) <= 19}")
    else:
        n = sum(map(len, groups))
        out += [f"phone:digits={n if 9 <= n <= 15 else 'off'}", f"phone:groups={'-'.join([str(len(g)) for g in groups[-3:]])}", f"phone:plus={span[0] == '+'},{'(' in signs and ')' in signs}"]
    out.append(f"{kind}:cue={before}")
    return tuple(out)


def _class(char: str) -> str:
    return "edge" if not char else "space" if char.isspace() else "digit" if char.isdigit() else "letter" if char.isalpha() else char if char in ".,;:()+-@" else "other"


def _edges(places: list[int]) -> list[int]:
    """The first few, nearest first, and the last."""
    return places[:EDGES] + places[-1:] if len(places) > EDGES else places


def spans_of_addresses(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """From the words before an at sign to the words behind it."""
    for at in _AT.finditer(text, low, high):
        end = at.start() - (text[at.start() - 1 : at.start()] == " ")
        start, least = end, max(low, end - MAX_ADDRESS)
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        behind = _BEHIND.match(text, at.end(), min(high, at.end() + MAX_ADDRESS))
        if start == end or not behind:
            continue
        starts = [m.start() for m in _WORD.finditer(text, start, end)][::-1]
        ends = [m.end() for m in _WORD.finditer(text, at.end(), behind.end())][1:]
        for a in _edges(starts):
            for b in _edges(ends):
                if b - a <= MAX_ADDRESS:
                    yield a, b


def spans_of_numbers(text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind's number) of groups of digits, with a sign or bracket in front, that have as many digits as their kind."""
    groups = [m.span() for m in _DIGITS.finditer(text, low, high)]
    total = [0, *accumulate(b - a for a, b in groups)]
    n = len(groups)
    # how far the gaps behind a group let a number go on
    reach = [0] * n
    for i in range(n - 1, -1, -1):
        reach[i] = i + 1
        if i + 1 < n:
            gap = text[groups[i][1] : min(groups[i + 1][0], groups[i][1] + MAX_GAP + 1)]
            if len(gap) <= MAX_GAP and not gap.strip(" ().-[]"):
                reach[i] = reach[i + 1]
    for i, (a, first) in enumerate(groups):
        last = min(reach[i], i + MAX_GROUPS)
        if total[last] - total[i] < 9:
            if last - i >= 4 and total[i + 4] - total[i] <= 12:
                yield a, groups[i + 3][1], 1
            continue
        starts = [a]
        while starts[-1] > low and (c := text[starts[-1] - 1]) in "(+" and text[starts[-1]] != "+" and text[starts[-1]] != c:
            starts.append(starts[-1] - 1)
        for j in range(i, last):
            digits, end = total[j + 1] - total[i], groups[j][1]
            if digits > 19:
                break
            if j == i + 3 and digits <= 12:
                yield a, end, 1
            if digits >= 12:
                yield a, end, 2
            if 9 <= digits <= 15:
                for start in starts:
                    yield start, end, 3


def segments(text: str, start: int, end: int, fixed: list[tuple[int, int]] = ()) -> tuple[list[int], dict[int, list[tuple[int, int, tuple[str, ...]]]]]:
    """Where candidates begin and end, and for each of those places, by number, (number of the start, kind, features) of every candidate that ends there and meets none of ``fixed`` (apart, ascending)."""
    rows, cues = [], {}
    for a, b, y in [*((a, b, 0) for a, b in spans_of_addresses(text, start, end)), *spans_of_numbers(text, start, end)]:
        k = bisect_left(fixed, (b, b))
        if k and fixed[k - 1][1] > a:
            continue
        if a not in cues:
            cues[a] = cue(text, a)
        if f := features(text, a, b, KINDS[y], cues[a]):
            rows.append((a, b, y, f))
    marks = sorted({p for a, b, *_ in rows for p in (a, b)})
    number = {p: k for k, p in enumerate(marks)}
    found: dict[int, list] = defaultdict(list)
    for a, b, y, f in rows:
        found[number[b]].append((number[a], y, f))
    return marks, found


def viterbi(text: str, start: int, end: int, weights: dict[str, float], fixed: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """The likeliest spans of a stretch beside the ``fixed`` ones."""
    marks, found = segments(text, start, end, fixed)
    if not found:
        return []
    best, how = [0.0] * len(marks), [None] * len(marks)
    for j in range(1, len(marks)):
        best[j] = best[j - 1]
        for i, y, f in found.get(j, ()):
            s = best[i] + sum(weights.get(x, 0.0) for x in f)
            if s > best[j] + 1e-9:
                best[j], how[j] = s, (i, y)
    out, j = [], len(marks) - 1
    while j:
        if how[j]:
            i, y = how[j]
            out.append((marks[i], y, marks[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _plus(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(snippets: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Weights for (text, spans) by stochastic gradient ascent; bias features begin below zero, so unknown shapes stay out."""
    weights: dict[str, float] = defaultdict(float, {f"{k}:": -2.0 for k in KINDS})
    cases = []
    for text, gold in snippets:
        marks, found = segments(text, 0, len(text))
        if found:
            cases.append((len(marks), found, {(marks.index(b), marks.index(a), y) for a, y, b in gold if a in marks and b in marks}))
    for turn in range(rounds):
        step = rate / (1 + turn / 4)
        for n, found, gold in cases:
            scored = {j: [(i, y, f, sum(weights[x] for x in f)) for i, y, f in own] for j, own in found.items()}
            ahead, back = [0.0] * n, [0.0] * n
            for j in range(1, n):
                ahead[j] = ahead[j - 1]
                for i, _, _, s in scored.get(j, ()):
                    ahead[j] = _plus(ahead[j], ahead[i] + s)
            into: dict[int, list] = defaultdict(list)
            for j, own in scored.items():
                for i, _, _, s in own:
                    into[i].append((j, s))
            for i in range(n - 2, -1, -1):
                back[i] = back[i + 1]
                for j, s in into.get(i, ()):
                    back[i] = _plus(back[i], back[j] + s)
            for j, own in scored.items():
                for i, y, f, s in own:
                    delta = ((j, i, y) in gold) - math.exp(min(0.0, ahead[i] + s + back[j] - ahead[-1]))
                    if abs(delta) > 1e-4:
                        for x in f:
                            weights[x] += step * (delta - decay * weights[x])
    return {k: round(v, 6) for k, v in weights.items()}


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The snippet with its spans in other spellings that people use for the same data."""
    out, gold, at = "", [], 0
    for a, y, b in spans:
        if a < at:
            continue
        span = text[a:b]
        new = (
            span.replace("@", rng.choice([" @ ", "[at]", "(at)"])) if y == 0
            else span.replace(".", "[.]") if y == 1
            else rng.choice([" ", ".", "-"]).join(span[i : i + 4] for i in range(0, len(span), 4)) if y == 2 and span.isdigit() and len(span) == 16
            else span.lstrip("+").split(" ", 1)[-1] if y == 3 and span.count("(") == 1 and sum(map(str.isdigit, span.split(" ", 1)[-1])) >= 9
            else span
        )
        out += text[at:a]
        gold.append((len(out), y, len(out) + len(new)))
        out, at = out + new, b
    return out + text[at:], gold


def train(docs: DataFrame) -> dict[str, float]:
    """Fits the model on snippets of about TRAIN_DOCS documents, at most TRAIN_SNIPPETS of them."""
    share = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select("doc_id", "text")

    def snippets():
        return lambda batch: {"snippet": [t[a:b] for t in batch.column("text").to_pylist() if t for a, b in islands(t) if b - a <= SNIPPET]}

    got = some.select("text").mapInArrow(by_batch(snippets, {"snippet": pa.string()}), "snippet string").distinct().orderBy(F.xxhash64("snippet"), "snippet").limit(TRAIN_SNIPPETS)
    texts = sorted(r[0] for r in got.collect())
    rng, cases = random.Random(7), []
    for text in [*texts, "mail a.b@c1.example.org now", "on 10.1.2.3 and", "pay 4111111111111111 by", "ring +1 (212) 555-0100 or", "the 1234567890123456 and 2021-03-04 10:20:30 or", "in 999.1.2.3 of"]:
        gold = base_spans(text)
        gold = [g for g in gold if not any(o is not g and o[0] <= g[0] and g[2] <= o[2] for o in gold)]
        cases.append((text, gold))
        if gold:
            cases.append(rewritten(text, gold, rng))
    release(docs.sparkSession)
    return fit(cases)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[y]}:{a}:{b}" for a, y, b in spans)


def find(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with what the model adds outside of them."""
    if not text:
        return [], []
    base = base_spans(text)
    fixed: list[tuple[int, int]] = []
    for a, _, b in base:
        if fixed and a < fixed[-1][1]:
            fixed[-1] = (fixed[-1][0], max(b, fixed[-1][1]))
        else:
            fixed.append((a, b))
    # stretches overlap nothing, so each stands for itself
    added = [span for start, end in islands(text) for span in viterbi(text, start, end, weights, fixed)]
    return base, sorted(base + added)


#: Arrays of spans, in code points.
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def named(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    return [{"kind": kinds[y], "start": a, "end": b} for a, y, b in spans]


def searched(docs: DataFrame, kinds: tuple[str, ...], finder) -> DataFrame:
    """doc_id, base and spans of each row; ``finder`` makes a worker's function from texts to both."""

    def build():
        find_in = finder()

        def work(batch: pa.RecordBatch) -> dict:
            found = [find_in(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "base": [named(x, kinds) for x, _ in found], "spans": [named(x, kinds) for _, x in found]}

        return work

    span = "array<struct<kind:string,start:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(by_batch(build, {"doc_id": pa.int64(), "base": SPANS, "spans": SPANS}), f"doc_id long, base {span}, spans {span}")


def personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) in code points.

    A null text counts as empty and has no spans. Rows that repeat are each
    searched, a null doc_id stays null; other columns are ignored. Without
    ``weights`` the model is trained first (an empty table trains on built-in
    snippets alone).
    """
    weights = train(docs) if weights is None else weights
    return searched(docs, KINDS, lambda: lambda text: find(text, weights))


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts of base spans for each kind, the SHA-256 of the base spans and all spans, joined."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
