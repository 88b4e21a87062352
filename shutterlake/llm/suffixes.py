"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are retained where a window's smallest hash of ``SEED`` words lies
(content-selected minimisers), so equal passages of ``LENGTH`` words retain the
same suffix. Suffixes whose first words are unique in the corpus are dropped; the
others are sorted by what follows, neighbours are compared, and matches are
extended to the right and to the left. A group of three or more suffixes with the
same beginning is extended jointly: for each number of words to the left, members
that agree on both sides are grouped, which equals comparing all pairs. A suffix
answers for the windows that have selected it, so each passage is looked at under
one beginning, with all documents that have it.

Suffixes of beginnings that more than ``HOT`` share (a licence text, a large group
of copies) are first reduced to one row for each context, with its smallest and
largest doc_id: copies become one suffix. Where more than ``HOT`` contexts are left,
the beginning is made deeper: windows with about as many words to the left share
that many words there and the rest to the right, and these join the key. That is
repeated for ever narrower ranges (``WIDTHS``); groups go to the array as soon as
they fit a task. At the narrowest a group's members are equal passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, WordHashes, ngram_hashes, release, scratch

LENGTH, SEED = 50, 12
SIDE = LENGTH - SEED
HOT = 500
#: Numbers of words to the left that the windows under one beginning may have; each width divides the one before.
WIDTHS = (64, 16, 4, 1)


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Of words between ASCII white space, A-Z lower-cased."""
    return hashes.array(text.encode("utf-8", "surrogatepass").lower().split() if text else [])


def retained(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that some window of SIDE + 1 seeds selects (its smallest, the first of equals), and the selected position for each window."""
    if len(seeds) <= SIDE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(seeds, SIDE + 1)
    chosen = windows.argmin(axis=1) + np.arange(len(windows))
    return np.unique(chosen), chosen


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        keys, docs, rows, places = [], [], [], []
        for doc, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
            words = word_hashes(text, hashes)
            if len(words) >= LENGTH:
                seeds = ngram_hashes(words, SEED)
                at, _ = retained(seeds)
                keys.append(seeds[at].view(np.int64))
                places.append(at.astype(np.int32))
                docs.append(np.full(len(at), doc, np.int64))
                rows.append(np.full(len(at), row, np.int64))
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys), "doc_id": np.concatenate(docs), "row": np.concatenate(rows), "pos": np.concatenate(places)})


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each suffix the words (32-bit hashes) after its seed and, from right to left, before it, and how many words to the left the windows have that it answers for."""
    hashes = WordHashes()
    for batch in batches:
        out = []
        for doc, text, suffixes in zip(batch["doc_id"], batch["text"], batch["suffixes"], strict=True):
            words = word_hashes(text, hashes)
            low = (words >> np.uint64(32)).astype("<u4")
            _, chosen = retained(ngram_hashes(words, SEED))  # ascending
            for s in suffixes:
                p = s["pos"]
                a, b = int(np.searchsorted(chosen, p)), int(np.searchsorted(chosen, p, "right"))
                out.append((s["key"], s["hot"], doc, p, p - b + 1, p - a, low[p + SEED : p + LENGTH].tobytes(), low[max(0, p - SIDE) : p][::-1].tobytes()))
        yield pd.DataFrame(out, columns=["key", "hot", "doc_id", "pos", "least", "most", "right", "left"])


def _unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as a matrix padded with noughts, and their lengths."""
    sizes = np.fromiter((len(b) // 4 for b in column), np.int64, len(column))
    out = np.zeros((len(column), SIDE), np.uint64)
    for r, b in enumerate(column):
        out[r, : sizes[r]] = np.frombuffer(b, "<u4")
    return out, sizes


def extended(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, least: np.ndarray, most: np.ndarray, right: list[bytes], left: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(doc_id, first word, end, other doc_id) of passages that whole groups of sorted suffixes share across documents.

    ``least`` and ``most`` bound the words to the left of the windows that a suffix answers for.
    """
    n, out = len(keys), []
    if n < 2:
        return out
    r, rn = _unpacked(right)
    l, ln = _unpacked(left)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, n])
    # two suffixes: compare the neighbours
    two = first[size == 2]
    two = two[docs[two] != docs[two + 1]]
    agree = lambda m, s: np.where((x := (m[two] != m[two + 1]) | (np.arange(SIDE) >= np.minimum(s[two], s[two + 1])[:, None])).any(1), x.argmax(1), SIDE)
    low = np.maximum(SIDE - agree(r, rn), np.maximum(least[two], least[two + 1]))
    high = np.minimum(agree(l, ln), np.minimum(most[two], most[two + 1]))
    for i, a, b in zip(two, low, high, strict=True):
        if a <= b:
            for x, y in ((i, i + 1), (i + 1, i)):
                out.append((docs[x], places[x] - b, places[x] - a + LENGTH, docs[y]))
    # more: group by what b words to the left and the rest to the right are
    rows = np.flatnonzero(np.repeat(size > 2, size))
    if not len(rows):
        return out
    roll = lambda m: np.concatenate([np.zeros((len(rows), 1), np.uint64), np.array(_rolled(m[rows])).T], axis=1)
    hr, hl = roll(r), roll(l)
    for b in range(SIDE + 1):
        fits = (least[rows] <= b) & (b <= most[rows])
        some = rows[fits]
        if len(some) < 2:
            continue
        mixed = (keys[some].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hl[fits, b]) * np.uint64(0xD6E8FEB86659FD93) + hr[fits, SIDE - b]
        order = np.lexsort((docs[some], mixed))
        starts = np.flatnonzero(np.r_[True, mixed[order][1:] != mixed[order][:-1]])
        ends = np.r_[starts[1:], len(order)]
        lows, highs = docs[some][order][starts], docs[some][order][ends - 1]
        for s, e, low, high in zip(starts, ends, lows, highs, strict=True):
            if low != high:
                out += [(docs[x], places[x] - b, places[x] - b + LENGTH, high if docs[x] == low else low) for x in some[order[s:e]]]
    return out


def _rolled(m: np.ndarray) -> list[np.ndarray]:
    """The hash of each row's first 1, 2, ... words."""
    out, h = [], np.full(len(m), 0x51, np.uint64)
    for k in range(m.shape[1]):
        h = (h ^ m[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def alike(keys: np.ndarray, lows: np.ndarray, highs: np.ndarray, least: np.ndarray, most: np.ndarray, right: list[bytes], left: list[bytes]) -> list[np.ndarray]:
    """Number of the row, fewest and most words to the left, smallest and largest doc_id of passages that whole groups of sorted contexts share.

    A context stands for all suffixes that have it; ``lows`` and ``highs`` are their smallest and largest doc_ids.
    """
    hr, hl = (np.column_stack([np.zeros(len(keys), np.uint64), *_rolled(_unpacked(side)[0])]) for side in (right, left))
    parts = [np.zeros((4, 0), np.int64)]
    for b in range(SIDE + 1):
        some = np.flatnonzero((least <= b) & (b <= most))
        if not len(some):
            continue
        mixed = (keys[some].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hl[some, b]) * np.uint64(0xD6E8FEB86659FD93) + hr[some, SIDE - b]
        _, starts, group = np.unique(np.sort(mixed), return_index=True, return_inverse=True)
        some = some[np.argsort(mixed, kind="stable")]
        low, high = np.minimum.reduceat(lows[some], starts)[group], np.maximum.reduceat(highs[some], starts)[group]
        shared = low < high
        parts.append(np.stack([some, np.full(len(some), b), low, high])[:, shared])
    row, b, low, high = (x := np.concatenate(parts, axis=1))[:, np.lexsort((x[1], x[3], x[2], x[0]))]
    if not len(row):
        return [row, b, b, low, high]
    # runs of windows with the same two documents
    fresh = np.r_[True, (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (b[1:] != b[:-1] + 1)]
    first = np.flatnonzero(fresh)
    return [row[first], b[first], b[np.r_[first[1:], len(b)] - 1], low[first], high[first]]


def _by_group(work: Callable[[pd.DataFrame], pd.DataFrame]):
    """For mapInPandas: ``work`` gets whole groups of sorted keys as they come; the last group of a batch waits for the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield work(held.iloc[:cut])
                held = held.iloc[cut:]
        if held is not None and len(held):
            yield work(held)

    return run


def _suffixes(rows: pd.DataFrame) -> pd.DataFrame:
    out = extended(*(rows[c].to_numpy() for c in ("key", "doc_id", "pos", "least", "most")), list(rows["right"]), list(rows["left"]))
    return pd.DataFrame(out, columns=["doc_id", "start", "end", "other_doc_id"])


def _classes(rows: pd.DataFrame) -> pd.DataFrame:
    row, *out = alike(*(rows[c].to_numpy() for c in ("key", "low", "high", "least", "most")), list(rows["right"]), list(rows["left"]))
    return pd.DataFrame(dict(zip(("class", "least", "most", "low", "high"), (rows["class"].to_numpy()[row], *out), strict=True)))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of touching passages, with a row for each of their links."""
    for batch in batches:
        out = []
        for doc, found in zip(batch["doc_id"], batch["found"], strict=True):
            start, end, others = None, -1, set()
            for s in sorted((s["start"], s["end"], s["other_doc_id"]) for s in found):
                if s[0] > end:
                    out += [(doc, start, end, o) for o in sorted(others)]
                    start, end, others = s[0], s[1], set()
                end = max(end, s[1])
                others.add(s[2])
            out += [(doc, start, end, o) for o in sorted(others)]
        yield pd.DataFrame(out, columns=["doc_id", "start_word", "end_word", "other_doc_id"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each link of a stretch of a document that passages of other documents cover: doc_id, start_word, end_word (exclusive), other_doc_id.

    A passage is LENGTH words (split at ASCII white space, A-Z lower-cased)
    that stand in documents with different doc_ids; overlapping or touching ones
    make one stretch. Each passage links to the smallest doc_id that has it, in
    that document to the largest; a stretch has a row for each different link of its
    passages, so all documents that share a passage are connected by rows. Documents without such a passage have no row. Null and short texts
    and rows without a doc_id take no part; rows that repeat are one document;
    other columns are ignored. The result is a table in the shared folder; the
    others written for it are dropped.
    """
    with scratch() as kept:
        out = Stored(_repeated_passages(docs), "passages")
        kept.append(out)
    return out.df


def _repeated_passages(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    seeds = Stored(base.mapInPandas(_seeds, "key long, doc_id long, row long, pos int"), "seeds")
    known = seeds.df.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c"))
    known = Stored(known.where("low < high").select("key", (F.col("c") > HOT).alias("hot")), "repeated")
    left = seeds.df.select("key", "row", "pos").join(known.df, "key")
    grouped = Stored(left.groupBy("row").agg(F.collect_set(F.struct("pos", "key", "hot")).alias("suffixes")), "suffixes")
    seeds.drop()
    release(docs.sparkSession)
    suffixes = base.join(grouped.df, "row").mapInPandas(_contexts, "key long, hot boolean, doc_id long, pos int, least int, most int, right binary, left binary")
    suffixes = Stored(suffixes.withColumn("class", F.when(F.col("hot"), F.xxhash64("key", "least", "most", "right", "left"))), "contexts")
    for t in (known, grouped):
        t.drop()
    release(docs.sparkSession)
    rare = suffixes.df.where("not hot").repartition("key").sortWithinPartitions("key", "right", "doc_id", "pos").mapInPandas(_by_group(_suffixes), "doc_id long, start int, end int, other_doc_id long")
    often = _hot(suffixes.df.where("hot"))
    spans = rare.unionByName(often).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "other_doc_id")).alias("found"))
    return spans.mapInPandas(_joined, "doc_id long, start_word int, end_word int, other_doc_id long")


def _hot(suffixes: DataFrame) -> DataFrame:
    """doc_id, start, end, other_doc_id of the passages under beginnings that many suffixes share."""
    context = ["class", "key", "least", "most", "right", "left"]
    classes = suffixes.groupBy(context).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).withColumn("seed", F.col("key"))
    found = []
    for width in WIDTHS[1:]:
        classes = Stored(classes, "classes").df
        large = Stored(classes.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("key"), "large").df
        found.append(_in_arrays(classes.join(large, "key", "left_anti")))
        if large.isEmpty():
            classes = None
            break
        classes = _deeper(classes.join(large, "key", "left_semi"), width)
    if classes is not None:  # one number of words to the left: members of a group are equal passages
        classes = Stored(classes.select("class", "key", "least", "most", "low", "high"), "classes").df
        groups = classes.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
        found.append(classes.select("class", "key", "least", "most").join(groups, "key").select("class", "least", "most", "low", "high"))
    shared = Stored(reduce(DataFrame.unionByName, found), "shared").df
    other = F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return suffixes.select("class", "doc_id", "pos").join(shared, "class").select("doc_id", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("end"), other.alias("other_doc_id"))


def _in_arrays(classes: DataFrame) -> DataFrame:
    ordered = classes.repartition("key").sortWithinPartitions("key", "right", "class")
    return ordered.mapInPandas(_by_group(_classes), "class long, least int, most int, low long, high long")


def _deeper(classes: DataFrame, width: int) -> DataFrame:
    """A row for each range of ``width`` numbers of words to the left that a context has windows in; its key has the words that all windows of the range share."""
    rows = classes.select("*", F.explode(F.expr(f"sequence(least div {width}, most div {width})")).alias("at"))
    low, high = F.col("at") * width, F.least((F.col("at") + 1) * width - 1, F.lit(SIDE))
    rows = rows.withColumns({"from": low.cast("int"), "to": high.cast("int")})
    key = F.xxhash64("seed", "from", F.expr("substring(left, 1, 4 * from)"), F.expr(f"substring(right, 1, 4 * ({SIDE} - to))"))
    return rows.withColumns({"key": key, "least": F.greatest("least", "from"), "most": F.least("most", "to")}).drop("at", "from", "to")
