"""Documents whose sets of word n-grams are alike, by a blocked product of the sparse document by n-gram matrix.

The matrix has a row for each distinct set and a column for each n-gram; an
entry of its product with its own transpose is the overlap of two documents. Sizes
alone bound what is worth multiplying: sets of n and m n-grams link only with an overlap
of at least need(n, m), so of a row's columns, in one order for all rows, the first
n - ceil(s n) + 1 must hold one that the other row has too. Only these entries
are multiplied. Counts of them are accumulated for each pair, and a pair is discarded
as soon as they and the most that the rest of the rows can add fall below need(n, m). What is
left is compared on whole sets, so every link is exact and none is lost.

Order of columns. Columns go by their hash, but those that over ``HOT`` rows have among
their first ones go behind all others. A row with too few others among its first ones
is read whole; columns that over ``HOT`` of those rows hold go behind as well.

Blocks. A column of at most ``LIST`` rows gives its pairs to a shuffle that
sums them. A longer one is cut by sizes (rows more than a factor s apart can't link),
and what is still longer into blocks of about ``ROWS`` rows: every two blocks meet in one
task, which multiplies their long columns, discards by the bounds, compares whole sets, and returns a
spanning forest of the links. Before that each row of a long column is compared with the
one row that stands first in most of its columns, and columns whose rows are in one
component by then are not multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, WordHashes, by_batch, release, scratch, small_batches
from .minhash import _Labels as Labels
from .minhash import shingle_set

HOT = 32
LIST = 32
#: Rows and n-grams of a block of a long column (on average).
ROWS = 1024
CELLS = 1 << 20
#: Bits of the filter that keeps texts of other rows out of a shuffle (16 MB, broadcast).
MOST_BITS = 1 << 27
TOP = np.uint64(1 << 63)

#: (id) -> (id, whole): whole rows of the matrix.
Wholes = Callable[[DataFrame], DataFrame]
SETS = "id long, n long, set_key binary, head array<long>"


def row(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """A text's n-grams as ascending longs."""
    return (shingle_set(text, words, hashes) ^ TOP).view(np.int64)


def first_columns(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _rows(words: int, percent: int):
    def build():
        import hashlib

        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            n, keys, heads = [], [], []
            for text in batch.column("text").to_pylist():
                own = row(text, words, hashes)
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                heads.append(own[: first_columns(len(own), percent) * 3 // 2 + 3])
            return {"id": batch.column("id"), "n": n, "set_key": keys, "head": heads}

        return work

    return by_batch(build, {"id": pa.int64(), "n": pa.int64(), "set_key": pa.binary(), "head": pa.list_(pa.int64())})


def _whole_rows(words: int):
    def build():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            found = [(d, own) for d, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if len(own := row(t, words, hashes))]
            return {"id": [d for d, _ in found], "whole": [x for _, x in found]}

        return work

    return by_batch(build, {"id": pa.int64(), "whole": pa.list_(pa.int64())})


def among(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``base`` whose id may be one of ``ids``: a bit for each hash, eight bits for each id and at most ``MOST_BITS``, broadcast as bitmaps.

    It only keeps texts out of a join's shuffle; with more ids than it has room for it lets more through.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (8 * max(1, ids.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    # bitmaps of 4,096 bytes
    maps = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_b"))
    rows = base.withColumns({"_k": F.bitmap_bucket_number(place), "_p": F.bitmap_bit_position(place)}).join(F.broadcast(maps), "_k")
    own = F.conv(F.hex(F.expr("substring(_b, cast(_p div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.call_function("shiftright", own, F.expr("cast(_p % 8 as int)")) % 2 == 1).select(base.columns)


def need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets."""
    return F.ceil((n + m) * percent / (100 + percent))


def rest(n: Column, percent: int) -> Column:
    """How many of n columns aren't among the first ones."""
    return F.ceil(n * percent / 100) - 1


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return linked


class _Ragged:
    """Lists of numbers as one array of local column numbers."""

    def __init__(self, lists: pd.Series):
        self.size = lists.map(len).to_numpy()
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        values, flat = np.unique(np.concatenate(lists.to_numpy()), return_inverse=True)
        self.flat, self.columns, self.values = flat.astype(np.int64), len(values), values

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def gathered(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.of(i) for i in rows])

    def by_column(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transpose over ``rows``: places in ``rows`` by column, and where each column begins."""
        column, place = self.gathered(rows), np.repeat(np.arange(len(rows)), self.size[rows])
        order = np.argsort(column, kind="stable")
        return place[order], np.searchsorted(column[order], np.arange(self.columns + 1))


def _block_product(percent: int):
    """Links between two blocks of a long column (or within one) that this column is the first to show, as a spanning forest."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        here, _, low, high = key
        ids, block, visits = (frame[c].to_numpy() for c in ("id", "part", "visits"))
        n, first = frame["n"].to_numpy(), frame["first"].to_numpy()
        on, whole = _Ragged(frame["vs"]), _Ragged(frame["whole"])
        this = int(np.searchsorted(on.values, here))
        root = np.unique(frame["label"].to_numpy(), return_inverse=True)[1]
        beyond, others = -(-n * percent // 100) - 1, first - on.size
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links: list[tuple[int, int]] = []
        if not len(left) or not len(right):
            return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        places, begin = on.by_column(right)
        has = np.zeros(whole.columns, np.uint8)
        for i in left:
            mine = on.of(i)
            rows = np.concatenate([places[begin[c] : begin[c + 1]] for c in mine])
            overlap = np.bincount(rows, minlength=len(right))
            earlier = np.zeros(len(right), bool)
            for c in mine[mine < this]:
                earlier[places[begin[c] : begin[c + 1]]] = True
            small, large = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
            most = overlap + np.minimum(others[right], others[i]) + np.maximum(beyond[right], beyond[i])
            fits = (overlap > 0) & ~earlier & (root[right] != root[i]) & (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large)) & ~(visits[right] & visits[i])
            if low == high:
                fits &= right < i
            with_ = right[fits]
            if not len(with_):
                continue
            own = whole.of(i)
            has[own] = 1
            shared = np.add.reduceat(has[whole.gathered(with_)], np.concatenate([[0], np.cumsum(whole.size[with_])[:-1]]), dtype=np.int64)
            has[own] = 0
            for j in with_[100 * shared >= percent * (n[i] + n[with_] - shared)]:
                if root[j] != root[i]:
                    links.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _first_entries(reps: DataFrame, wholes: Wholes, percent: int) -> DataFrame:
    """id, n and prefix: the first columns of each row of ``reps`` (id, n, head) in the order of all columns; ``wholes`` gives whole rows by ids."""
    count = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    values = reps.select("id", F.explode("head").alias("v"))
    often = Stored(values.groupBy("v").count().where(F.col("count") > HOT).select("v", F.lit(2).alias("level")), "often").df

    def ordered(rows: DataFrame, column: str, late: DataFrame) -> DataFrame:
        """``rows`` with early, the columns that aren't late, and all, with the late ones behind."""
        found = rows.select("id", F.explode(column).alias("v")).join(late, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "v"))).alias("_late"))
        got = rows.join(found, "id", "left").withColumn("_l", F.coalesce(F.col("_late.v"), F.array().cast("array<bigint>")))
        got = got.withColumn("early", F.array_except(column, "_l"))
        return got.withColumn("all", F.concat("early", "_l")).drop("_late", "_l")

    enough = (F.size("early") >= count) | (F.size("head") == F.col("n"))
    short = Stored(ordered(reps, "head", often).where(~enough).select("id"), "short").df
    late, some = often, None
    if not short.isEmpty():
        some = Stored(wholes(short), "short_rows").df
        again = some.select(F.explode("whole").alias("v")).join(often, "v", "left_anti").groupBy("v").count()
        late = Stored(often.union(again.where(F.col("count") > HOT).select("v", F.lit(1).alias("level"))), "late").df
    out = Stored(ordered(reps, "head", late).select("id", "n", F.when(enough, F.slice("all", F.lit(1), count)).alias("prefix")), "prefixes").df
    if some is None:
        return out
    rows = out.where("prefix is null").select("id", "n")
    fresh = Stored(rows.select("id").join(short, "id", "left_anti"), "fresh").df
    whole = some if fresh.isEmpty() else some.unionByName(wholes(fresh))
    late_rows = ordered(rows.join(whole, "id"), "whole", late).select("id", "n", F.slice("all", F.lit(1), count).alias("prefix"))
    return out.where("prefix is not null").unionByName(late_rows)


def _confirmed(labels: Labels, pairs: DataFrame, whole: DataFrame, percent: int) -> None:
    """Unites the components of the ``pairs`` (a, b) whose whole sets link them."""
    x, y = whole.toDF("a", "wa"), whole.toDF("b", "wb")
    found = Stored(pairs.join(x, "a").join(y, "b").where(_linked(percent)("wa", "wb")).select("a", "b"), "found").df
    labels.merge(labels.between(found).select(F.col("x").alias("a"), F.col("y").alias("b")))


def alike(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link if 100 * intersection >= ``percent`` * union of their sets of
    ``words`` words in a row (A-Z lower-cased, words end at ASCII white space); component_id
    is the smallest doc_id reachable. Fewer words are one n-gram; a null, empty or blank
    text has none and links with nothing. Rows that repeat a doc_id are one document,
    which links what any of them links; rows without one link nothing and have no
    component. Other columns are ignored, an empty table gives an empty result. All
    work is done when this returns; the result's table stays in the shared folder.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    with small_batches(docs.sparkSession), scratch() as kept:
        known = base.where("id is not null")
        if known.groupBy("id").count().where("count > 1").limit(1).isEmpty():
            rows = _alike(known, percent, words).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
        else:
            rows = _repeated(known, percent, words)
        none = Stored(base.where("id is null").mapInArrow(_rows(words, percent), SETS), "without").df
        rows = rows.unionByName(none.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
        found = Stored(rows, "alike")
        kept.append(found)
    return found.df


def _repeated(known: DataFrame, percent: int, words: int) -> DataFrame:
    """The same where rows repeat an id: each row gets a number of its own, and rows of one id are united afterwards."""
    numbered = Stored(known.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "text"), "numbered").df
    found = _alike(numbered.select(F.col("row").alias("id"), "text"), percent, words).withColumnRenamed("id", "row")
    found = Stored(found.join(numbered.select("row", "doc_id"), "row").select("doc_id", "n_shingles", "component_id"), "rows").df
    labels = Labels(known.sparkSession)
    ends = found.groupBy("doc_id").agg(F.min("component_id").alias("low"))
    labels.merge(found.join(ends, "doc_id").where("component_id > low").select(F.col("component_id").alias("a"), F.col("low").alias("b")))
    merged = Stored(labels.of(found, "component_id", "whole"), "merged").df
    least = merged.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    return merged.drop("component_id").join(least, "whole").select("doc_id", "n_shingles", "component_id")


def _alike(base: DataFrame, percent: int, words: int) -> DataFrame:
    """id, n_shingles, component_id for ``base`` (id, text), whose ids are all different."""
    spark = base.sparkSession
    fat = Stored(base.mapInArrow(_rows(words, percent), SETS), "sets")
    one = Stored(fat.df.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("head").alias("head")), "heads")
    sets = Stored(fat.df.select("id", "n", "set_key"), "sizes").df
    fat.drop()

    def wholes(ids: DataFrame) -> DataFrame:
        some = Stored(ids.select("id").distinct(), "ids").df
        return among(base, some).join(some, "id", "left_semi").mapInArrow(_whole_rows(words), "id long, whole array<long>")

    with scratch() as kept:
        prefixes = Stored(_first_entries(one.df.select(F.col("rep").alias("id"), "n", "head"), wholes, percent), "first_columns")
        kept.append(prefixes)
    classes = Stored(one.df.select("set_key", "rep"), "classes").df
    one.drop()
    release(spark)
    labels = Labels(spark)
    _links(labels, prefixes.df, wholes, percent)
    rows = sets.join(classes, "set_key", "left").withColumn("rep", F.coalesce("rep", "id"))
    return labels.of(rows, "rep", "component_id").select("id", F.col("n").alias("n_shingles"), "component_id")


def _links(labels: Labels, prefixes: DataFrame, wholes: Wholes, percent: int) -> None:
    """Unites in ``labels`` all rows that link. ``prefixes``: id, n, prefix."""
    entries = prefixes.select("id", "n", F.posexplode("prefix").alias("at", "v"))
    sizes = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = Stored(entries.join(sizes, "v"), "shared")
    near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    # rows that may link lie in one band of sizes or in two that follow each other; in the upper one the lower one's rows are visitors
    step = max(1e-6, math.log(100 / percent) * (1 + 1e-9))
    band = F.floor(F.log("n") / step).cast("int")
    homes = F.array(F.struct(band.alias("band"), F.lit(False).alias("visits")), F.struct((band + 1).alias("band"), F.lit(True).alias("visits")))
    long = shared.df.where(F.col("c") > LIST)
    banded = long.select("v", "id", "n", "at", F.inline(homes))
    cut = banded.groupBy("v", "band").agg(F.count("*").alias("c"), F.min(F.when(~F.col("visits"), F.col("id"))).alias("pivot"), F.sum("n").alias("cells")).where("c > 1 and pivot is not null")
    cut = Stored(cut, "cut").df
    blocked = Stored(banded.join(cut.where(F.col("c") > LIST), ["v", "band"]), "blocked").df

    # short columns: the counts of each pair's common entries
    own = shared.df.where(F.col("c") <= LIST).select("v", F.lit(-1).alias("band"), "id", "n", "at", F.lit(False).alias("visits"))
    own = own.unionByName(banded.join(cut.where(F.col("c") <= LIST).select("v", "band"), ["v", "band"]).select("v", "band", "id", "n", "at", "visits"))
    named = lambda k: [F.col("id").alias(k), F.col("n").alias(f"n{k}"), (F.col("n") - 1 - F.col("at")).alias(f"after_{k}")]
    x, y = own.where("not visits").select("v", "band", *named("i")), own.select("v", "band", *named("j"), "visits")
    both = x.join(y, ["v", "band"]).where((F.col("visits") | (F.col("i") < F.col("j"))) & near(F.col("ni"), F.col("nj")))
    counts = both.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.least("ni", "nj").alias("n"), F.greatest("ni", "nj").alias("m")).agg(F.count("*").alias("c"), F.min(F.least("after_i", "after_j")).alias("after"))
    # behind the last common entry the shorter rest bounds what is common; entries of long columns aren't among these counts
    more = Stored(long.groupBy("id").agg(F.count("*").alias("more")), "more").df
    counts = counts.join(more.toDF("a", "la"), "a", "left").join(more.toDF("b", "lb"), "b", "left")
    most = F.col("c") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) + F.least(F.col("after"), rest(F.col("m"), percent))
    least = need(F.col("n"), F.col("m"), percent)
    likely = Stored(counts.where(most >= least).select("a", "b", (F.col("c") / least).alias("e")), "likely").df

    # long columns: each row with the row that stands first in most of them
    firsts = blocked.join(prefixes.select(F.col("id").alias("pivot"), F.col("n").alias("pn")), "pivot").where(near(F.col("n"), F.col("pn")) & F.expr("id <> pivot"))
    chosen = firsts.groupBy("id", "pivot").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("x"))
    chosen = Stored(chosen.select(F.col("id").alias("a"), (-F.col("x.p")).alias("b")), "chosen").df
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).union(chosen.select(F.explode(F.array("a", "b")))).union(blocked.select("id"))
    whole = Stored(wholes(wanted), "whole").df
    shared.drop()
    release(prefixes.sparkSession)

    _confirmed(labels, chosen, whole, percent)
    # of short columns' pairs first each component's likeliest, then those that are still apart
    open_ = Stored(labels.between(likely), "open").df
    each = open_.select(F.explode(F.array("x", "y")).alias("one"), F.struct("e", "a", "b").alias("p"))
    _confirmed(labels, Stored(each.groupBy("one").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct(), "best").df, whole, percent)
    _confirmed(labels, Stored(labels.between(open_.select("a", "b")).select("a", "b"), "apart").df, whole, percent)
    _multiply(labels, blocked, whole, percent)


def _multiply(labels: Labels, blocked: DataFrame, whole: DataFrame, percent: int) -> None:
    """Unites what long columns link: ``blocked`` has their rows (v, band, id, n, visits)."""
    rows = Stored(labels.of(blocked.select("v", "band", "id", "n", "visits"), "id", "label"), "labelled").df
    parts = F.ceil(F.greatest(F.count("*") / ROWS, F.sum("n") / CELLS)).cast("int").alias("parts")
    cut = rows.groupBy("v", "band").agg(parts, F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("v", "band", "parts")
    cut = Stored(cut, "columns").df
    blocks = cut.agg(F.sum(F.expr("parts * (parts + 1) div 2"))).first()[0]
    if not blocks:
        return
    tasks = min(int(blocks), max(200, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    member = rows.join(cut, ["v", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    each = member.groupBy("id", "n", "band", "visits", "label").agg(F.collect_list(F.struct("v", "part", "parts")).alias("lists"), F.sort_array(F.collect_set("v")).alias("vs"))
    first = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("first")
    wide = each.join(whole, "id").select("id", "n", first, "band", "visits", "label", "vs", "whole", F.inline("lists"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    wide = wide.select("v", "band", "low", "high", "id", "n", "first", "part", "visits", "label", "vs", "whole").repartition(tasks, "v", "band", "low", "high")
    found = wide.groupBy("v", "band", "low", "high").applyInPandas(_block_product(percent), "a long, b long")
    labels.merge(labels.between(Stored(found, "found").df).select(F.col("x").alias("a"), F.col("y").alias("b")))
