"""Packing token sequences by cutting-stock column generation.

Documents are tokenised; each is cut into full sequences and a tail. The tails'
length histogram (in units of ``UNIT`` tokens, so its size is fixed) gives a
linear program over patterns, sets of lengths that fill one sequence. Its columns
are generated by a knapsack dynamic program over the dual prices. Patterns that
fill a sequence well are rounded down to whole numbers, and documents, ranked
within their length, are dealt to them. What rounding leaves, and tails shorter
than ``SHORT``, are laid end to end and cut at the sequence length; the last
stretch is cut at powers of two, which need no padding.

Documents can come with an order. Each length's documents are then dealt to the
patterns evenly along it: each sequence aims at one point of the order, for all
lengths in it, and the points of a length are matched with its documents in order.
Sequences are numbered by the first place in them.
"""

from __future__ import annotations

import json
import zlib
from array import array
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, by_batch, release, scratch

SIZE = 4096
UNIT, SHORT = 8, 64
#: Share of a sequence that a pattern fills at least.
FILL = 0.98
#: One run of the dynamic program prices so many patterns at most.
EACH = 8
#: Documents are ranked within so many parts at least, and one for each PART_ROWS documents.
PARTS, PART_ROWS = 256, 200_000
#: With an order, a part is a stretch of so many places.
PART_PLACES = 1 << 14

CUT = ("row", "start", "length", "ids_crc32")
TOKENS = "doc_id long, row long, place long, n long, crc long, chunk_crcs array<long>, tail_crc long"


#: Stands for the end of a word; no UTF-8 text has it.
END_BYTE = b"\xff"


def word_encoder(model: str):
    """A quicker way to the same ids for single words, or None where the tokenizer isn't of that kind.

    A byte-level BPE with ends of words, whose ids count up in the order of its
    merges, is the same as one over bytes that merges the smallest id first, with
    the end of the word as one more byte.
    """
    rules = json.loads(model)["model"]
    vocabulary, merges = rules.get("vocab", {}), rules.get("merges", [])
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if rules.get("end_of_word_suffix") != "</w>" or any(vocabulary.get(m) != 512 + i for i, m in enumerate(joined)):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = (b for b in range(256) if b not in set(plain))
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    ranks = {}
    for token, i in vocabulary.items():
        if i < 512 + len(merges):
            ends = token.endswith("</w>") and len(token) > 4
            ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + END_BYTE * ends] = i
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Ids(dict):
    """Chunk between white space -> its ids as 32-bit bytes (little-endian, as on all machines Spark's Arrow runs on). Emptied at ``limit`` entries.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks in order.
    """

    def __init__(self, model: str, end: int, limit: int = 100_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_str(model), limit
        self.end = array("I", [end]).tobytes()
        self.words = word_encoder(model)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if chunk[-1] in ".,;:!?|" and (c := chunk[-2:-1]).isalpha() and len(c.lower()) == 1:  # punctuation is a token of its own
            out = self[chunk[:-1]] + self[chunk[-1]]
        elif self.words and chunk.isalpha() and max(chunk) <= "\xff":  # one word, composed; lower case changes no length
            out = array("I", self.words(chunk.lower().encode() + END_BYTE)).tobytes()
        else:
            out = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = out
        return out

    def of(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        return b"".join(map(self.__getitem__, text.split())) + self.end


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes (ascending) within the capacity: its value and how often it has each."""
    best, last = _values(prices, sizes, capacity)
    return float(best[capacity]), _filled(last, sizes, capacity)


def _values(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room up to the capacity the greatest value, and the size that reaches it (-1: one less room does)."""
    best, last = np.zeros(capacity + 1), [-1] * (capacity + 1)
    # best[room - sizes] for growing rooms is one gather from a shifted copy of sizes
    fits, back = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist(), -sizes
    top = 0.0
    for room in range(1, capacity + 1):
        if n := fits[room]:
            value = best[back[:n] + room]
            value += prices[:n]
            k = int(value.argmax())
            if (v := float(value[k])) > top + 1e-12:
                top, last[room] = v, k
        best[room] = top
    return best, last


def _filled(last: list[int], sizes: np.ndarray, room: int) -> np.ndarray:
    times = np.zeros(len(sizes), np.int64)
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            times[last[room]] += 1
            room -= int(sizes[last[room]])
    return times


def _fullest(sizes: list[int], alive: list[int], room: int) -> list[int]:
    """Which of the ``alive`` sizes (numbers, ascending sizes) fill the most of ``room``, longest first; the knapsack whose prices are the sizes, over bits."""
    mask, sums = (1 << (room + 1)) - 1, 1
    for k in alive:
        if (step := sizes[k]) > room:
            break
        while step <= room:  # 1, 2, 4, ... of them
            sums |= (sums << step) & mask
            step *= 2
    taken, left = [], sums.bit_length() - 1
    for k in reversed(alive):
        while sizes[k] <= left and sums >> (left - sizes[k]) & 1:
            taken.append(k)
            left -= sizes[k]
    return taken


class _Master:
    """The restricted linear program: a basis of patterns, its inverse, and how often each is used. No BLAS: its threads stall beside a busy JVM."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, capacity: int):
        self.counts = counts
        self.columns = np.diag(capacity // sizes).astype(float)
        self.inverse = np.diag(1 / np.diag(self.columns))
        self.use = counts / np.diag(self.columns)

    def direction(self, times: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(times)
        return (self.inverse[:, some] * times[some]).sum(1)

    def put(self, out: int, times: np.ndarray, d: np.ndarray) -> None:
        """The pattern takes the place of the basis' column ``out``."""
        self.columns[:, out] = times
        row = self.inverse[out] / d[out]
        some = np.flatnonzero(np.abs(d) > 1e-13)
        self.inverse[some] -= d[some][:, None] * row
        self.inverse[out] = row

    def enter(self, times: np.ndarray) -> None:
        d = self.direction(times)
        up = np.flatnonzero(d > 1e-7)
        # of the columns that leave about first, the one with the largest pivot
        most = ((self.use[up] + 1e-9 * self.counts.max()) / d[up]).min()
        near = up[self.use[up] <= most * d[up]]
        out = int(near[d[near].argmax()])
        step = self.use[out] / d[out]
        self.use = np.maximum(self.use - step * d, 0)
        self.use[out] = step
        self.put(out, times, d)

    def renew(self) -> None:
        """One step against what has added up: the uses are corrected by the basis' residual."""
        for _ in range(2):
            rest = self.counts - (self.columns * self.use).sum(1)
            self.use = self.use + (self.inverse * rest).sum(1)
        self.use = np.maximum(self.use, 0)


def patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 1e-9, rounds: int = 4000) -> tuple[list[tuple[float, np.ndarray]], float]:
    """The linear program's (how often, times of each size), by column generation, and a proven lower bound of their sum.

    The first basis comes from the knapsack at the prices that lengths have as
    material: the longest length left is filled up with others, and the pattern is
    used until one of its lengths is out. Then simplex prices, drawn to those of the
    best bound so far, price new patterns by dynamic programming, for each length the
    best pattern that has it. Lengths whose price is negative (the basis has
    too many of them) are left out of a new pattern. It ends when the sum is within ``gap``
    of the bound, or after ``rounds`` patterns: what is not packed well then is laid
    end to end like all that rounding leaves.
    """
    m = len(sizes)
    if not m:
        return [], 0.0
    master, lengths, left = _Master(sizes, counts, capacity), [int(s) for s in sizes], counts.astype(float)
    alive = list(range(m))
    while alive:
        times = np.zeros(m, np.int64)
        times[alive[-1]] = 1
        np.add.at(times, _fullest(lengths, alive, capacity - lengths[alive[-1]]), 1)
        some = np.flatnonzero(times)
        ratio = left[some] / times[some]
        out = int(some[ratio.argmin()])
        left[some] -= ratio.min() * times[some]
        master.put(out, times, master.direction(times))
        master.use[out] = ratio.min()
        alive.remove(out)
    centre = sizes / capacity
    bound = float((counts * centre).sum())
    added = 0
    while added < rounds:
        prices, pull, before = master.inverse.sum(0), 0.95, added
        while added == before:
            asked = pull * centre + (1 - pull) * np.maximum(prices, 0)
            best, last = _values(asked, sizes, capacity)
            if (low := float((counts * asked).sum()) / max(float(best[capacity]), 1e-9)) > bound:
                bound, centre = low, asked / best[capacity]
            # for each length, the best pattern that has it
            for k in np.argsort(-(asked + best[capacity - sizes]), kind="stable")[:EACH]:
                times = _filled(last, sizes, capacity - int(sizes[k]))
                times[k] += 1
                times[prices < 0] = 0
                if float((prices * times).sum()) > 1 + 1e-9:
                    master.enter(times)
                    prices, added = master.inverse.sum(0), added + 1
                    if added % 100 == 0:
                        master.renew()
            if not pull:
                break
            pull = 0.0 if pull < 0.3 else pull / 2
        if added == before or master.use.sum() <= bound * (1 + gap):
            break
    master.renew()
    return [(float(master.use[p]), master.columns[:, p].astype(np.int64)) for p in range(m) if master.use[p] > 1e-9], bound


def dealt(bins: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (bin, from rank, to rank, copies in a sequence, first sequence, slot), and the number of sequences they fill."""
    order = sorted(bins)
    sizes, counts = np.array(order, np.int64), np.array([bins[b] for b in order], float)
    capacity = size // UNIT
    left, rows, sequences = dict(bins), [], 0
    for use, times in sorted(patterns(sizes, counts, capacity)[0], key=lambda p: (-p[0], tuple(p[1]))):
        whole = int(use + 1e-6)
        whole = min([whole, *(left[order[k]] // int(times[k]) for k in np.flatnonzero(times))])
        if whole and (times @ sizes) >= FILL * capacity:
            slot = 0
            for k in np.flatnonzero(times)[::-1]:
                b, a = order[k], int(times[k])
                done = bins[b] - left[b]
                rows.append((b, done, done + a * whole, a, sequences, slot))
                left[b] -= a * whole
                slot += a
            sequences += whole
    return rows, sequences


def _ranked(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``df`` (with a part) and each row's rank from 0 among those of its keys: within its part by ``by``, plus the rows of earlier parts."""
    counts = df.groupBy(*keys, "part").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_below"))
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*by))
    return df.withColumn("_own", own).join(counts, [*keys, "part"]).withColumn(name, F.col("_own") - 1 + F.col("_below")).drop("_own", "_below")


def _slots(spark: SparkSession, table: list[tuple[int, int, int, int, int, int]], bins: dict[int, int], parts: int) -> DataFrame:
    """A row for each tail: bin, rank in it, and the seq and slot to go to (null for the rest), ranked by the point aimed at.

    A pattern's sequences aim at even steps, patterns at golden sections of a step; the rest is spread evenly.
    """
    number = {first: p for p, first in enumerate(sorted({r[4] for r in table}))}
    plan = [(b, (high - low) // copies, copies, first, slot, (0.5 + number[first]) * (5**0.5 - 1) / 2 % 1) for b, low, high, copies, first, slot in table]
    for b, low, high, *_ in table:
        bins = bins | {b: bins[b] - (high - low)}
    plan += [(b, c, 1, None, None, 0.5) for b, c in bins.items() if c]
    # a row for each length in each pattern: no more for more data
    rows = spark.createDataFrame(plan, "bin int, whole long, copies long, first long, slot long, phase double")
    rows = rows.select("*", F.explode(F.expr(f"sequence(0L, whole * copies - 1, {PART_PLACES}L)")).alias("from")).repartition("bin", "first", "from")
    rows = rows.select("*", F.explode(F.expr(f"sequence(from, least(from + {PART_PLACES}L, whole * copies) - 1)")).alias("item"))
    rows = rows.withColumn("aim", F.expr("(item div copies + phase) / whole"))
    rows = _ranked(rows.withColumn("part", F.expr(f"cast(aim * {parts} as int)")), ["bin"], ["aim", "first", "item"], "rank")
    return rows.select("bin", "rank", F.expr("first + item div copies").alias("seq"), F.expr("slot + item % copies").alias("slot"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Sequences numbered anew from 0 by the first place in them (column place, which goes)."""
    firsts = pieces.groupBy("sequence_id").agg(F.min("place").alias("place"))
    ranked = _ranked(firsts.withColumn("part", F.expr(f"place div {PART_PLACES}")), [], ["place", "sequence_id"], "_to")
    to = Stored(ranked.select(F.col("sequence_id").alias("_from"), F.col("_to").cast("long").alias("_to")), "numbers").df
    names = [c for c in pieces.columns if c != "place"]
    return pieces.join(to, F.col("sequence_id") == F.col("_from")).withColumn("sequence_id", F.col("_to")).select(names)


def _tokenised(model, end: int, size: int):
    def build():
        ids, width = Ids(model.value, end), 4 * size

        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in batch.column("text").to_pylist():
                raw = ids.of(text)
                full = len(raw) // width
                rows.append((len(raw) // 4, zlib.crc32(raw), [zlib.crc32(raw[k * width : (k + 1) * width]) for k in range(full)], zlib.crc32(raw[full * width :])))
            n, crc, chunks, tail = zip(*rows, strict=True) if rows else ((),) * 4
            return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "place": batch.column("place"), "n": n, "crc": crc, "chunk_crcs": chunks, "tail_crc": tail}

        return work

    return by_batch(build, {"doc_id": pa.int64(), "row": pa.int64(), "place": pa.int64(), "n": pa.int64(), "crc": pa.int64(), "chunk_crcs": pa.list_(pa.int64()), "tail_crc": pa.int64()})


def _cut(model, end: int):
    def build():
        ids = Ids(model.value, end)

        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for row, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "cuts")), strict=True):
                raw = ids.of(text)
                rows += [(row, c["start"], c["length"], zlib.crc32(raw[4 * c["start"] : 4 * (c["start"] + c["length"])])) for c in cuts]
            return dict(zip(CUT, zip(*rows, strict=True) if rows else ((),) * len(CUT), strict=True))

        return work

    return by_batch(build, dict.fromkeys(CUT, pa.int64()))


def packed(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = 2, order: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, followed by ``end``, lie in exactly one piece each. A
    null or empty text is its end id alone. Rows that repeat a doc_id are packed
    one by one. An empty table gives no pieces; other columns are ignored.
    ``order`` names a column of places (whole numbers, none negative): sequences
    then follow it. Without it documents are dealt by hash. The result is a table
    in the shared folder; the others written for it are dropped.
    """
    with scratch() as kept:
        out = Stored(_packed(docs, tokenizer_path, size, end, order), "packed")
        kept.append(out)
    return out.df


def _packed(docs: DataFrame, tokenizer_path: str, size: int, end: int, order: str | None) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary: its size doesn't depend on the data
    # equal rows share a number, rows without an id are told apart by their texts
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), F.lit(0), "text").alias("row"), (F.col(order) if order else F.lit(0)).cast("long").alias("place"))
    tokens = Stored(base.mapInArrow(_tokenised(model, end, size), TOKENS), "tokens").df
    parts = max(PARTS, tokens.count() // PART_ROWS)
    rows = tokens.withColumns({"full": F.size("chunk_crcs").cast("long"), "tail": F.col("n") - F.size("chunk_crcs") * size, "part": F.expr(f"place div {PART_PLACES}") if order else F.pmod(F.xxhash64("doc_id", "crc"), F.lit(parts)).cast("int")})
    by = ["place", "doc_id", "crc"] if order else ["doc_id", "crc"]

    # full sequences, numbered through parts
    long = rows.where("full > 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.groupBy("part").agg(F.sum("full").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    first = long.withColumn("own", F.coalesce(F.sum("full").over(in_part), F.lit(0))).join(offsets, "part")
    chunks = first.select("doc_id", "place", "n", (F.col("base") + F.col("own")).alias("first"), F.posexplode("chunk_crcs").alias("k", "ids_crc32"))
    chunks = chunks.select("doc_id", "place", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # tails by length: as many rows as there are lengths
    tails = rows.where("tail > 0").select("doc_id", "row", "place", "n", "crc", "tail", "tail_crc", "part", F.when(F.col("tail") >= SHORT, F.ceil(F.col("tail") / UNIT)).otherwise(0).cast("int").alias("bin"))
    sums = tails.groupBy("bin").agg(F.count("*").alias("c")).collect()
    done = rows.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    table, sequences = dealt({r["bin"]: r["c"] for r in sums if r["bin"]}, size)
    ranges: dict[int, list] = {}
    for b, *rest in table:
        ranges.setdefault(b, []).append(tuple(rest))
    ranked = _ranked(tails, ["bin"], by, "rank")
    if order:
        ranked = ranked.join(_slots(spark, table, {r["bin"]: r["c"] for r in sums}, parts), ["bin", "rank"])
    else:
        # at most one row for each of the size / UNIT lengths
        plan = spark.createDataFrame(sorted(ranges.items()), "bin int, ranges array<struct<low:long,high:long,copies:long,first:long,slot:long>>")
        at = F.expr("get(filter(ranges, r -> r.low <= rank and rank < r.high), 0)")
        ranked = ranked.join(F.broadcast(plan), "bin", "left").withColumn("at", at)
        ranked = ranked.withColumns({"seq": F.expr("at.first + (rank - at.low) div at.copies"), "slot": F.expr("at.slot + (rank - at.low) % at.copies")})
    placed = Stored(ranked.select("doc_id", "row", "place", "n", "crc", "tail", "tail_crc", "part", "seq", "slot"), "placed").df

    in_pattern = placed.where("seq is not null")
    along = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = in_pattern.select("doc_id", "place", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("seq") + done).alias("sequence_id"), F.coalesce(F.sum("tail").over(along), F.lit(0)).alias("offset"))

    # the rest end to end
    rest = placed.where("seq is null")
    totals = rest.groupBy("part").agg(F.sum("tail").alias("s"))
    total = totals.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    last = total // size * size
    powers = [1 << k for k in range(size.bit_length(), -1, -1) if (total - last) >> k & 1]
    ends = [last, *(last + x for x in accumulate(powers))][:-1] if powers else [last]
    lay = totals.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    laid = rest.join(lay, "part").withColumn("from", F.col("base") + F.coalesce(F.sum("tail").over(in_part), F.lit(0)))
    marks = F.array(*(F.lit(x).cast("long") for x in ends))
    laid = laid.withColumn("marks", marks).withColumn("cuts", F.expr(f"array_sort(array_distinct(concat(array(from), filter(transform(sequence(from div {size}, (from + tail - 1) div {size}), k -> k * {size}), c -> c > from), filter(marks, c -> c > from and c < from + tail))))"))
    pieces = laid.select("*", F.posexplode("cuts").alias("i", "pos")).withColumn("length", F.expr("coalesce(get(cuts, i + 1), from + tail) - pos"))
    in_last = F.expr(f"filter(marks, c -> c <= pos and pos >= {last}L)")
    pieces = pieces.withColumns({"start": F.expr("n - tail + pos - from"), "sequence_id": F.when(F.col("pos") < last, F.expr(f"pos div {size}")).otherwise(F.lit(last // size) + F.size(in_last) - 1) + done + sequences, "offset": F.when(F.col("pos") < last, F.expr(f"pos % {size}")).otherwise(F.col("pos") - F.coalesce(F.array_max(in_last), F.lit(0)))})
    pieces = Stored(pieces.select("doc_id", "row", "place", "start", "length", F.when(F.size("cuts") == 1, F.col("tail_crc")).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"), "pieces").df
    cut = pieces.where("ids_crc32 is null")
    wanted = Stored(cut.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("cuts")), "cuts").df
    texts = base.join(wanted, "row").select("row", "text", "cuts")
    crcs = texts.mapInArrow(_cut(model, end), "row long, start long, length long, ids_crc32 long").distinct()
    names = ["doc_id", *(["place"] if order else []), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = cut.drop("ids_crc32").join(crcs, ["row", "start", "length"])
    release(spark)
    out = chunks.select(names).unionByName(whole.select(names)).unionByName(pieces.where("ids_crc32 is not null").select(names)).unionByName(cut.select(names))
    return _numbered(Stored(out, "packed").df) if order else out
