"""Near-duplicate documents by bottom-k sketches from one hash function.

Each document's set of word shingles is hashed once. The ``SKETCH`` smallest
hashes are its sketch. Inverted lists over the first few of them (``prefix``)
generate overlaps; the sketch of the union estimates the Jaccard similarity and
filters; exact Jaccard over the full sets confirms every link.

Which values are retained. Two sets with similarity s fail to share any of their
first m values only if none of the m smallest of the union lies in both, which
has probability below (1 - s)^m: under 1e-13 for s = 0.85 and m = 16. Small sets
need fewer, as n - ceil(s n) + 1 values always meet. Values held by more than
``HOT`` documents go behind all others in that order (rare first), so a common
line or passage doesn't fill the lists.

Hot groups. Documents with equal sets are one class from the start. Lists of at
most ``LIST`` members give pairs, which are at most ``LIST`` / 2 for each member. A
longer list isn't expanded: its members are dealt into blocks of bounded rows and
shingles, and a task for each two blocks holds the sets of both and looks at a pair
only if this is the first long list that the two share and they aren't linked yet. It
returns a spanning forest of the links that it found, so a group of n near copies
is sent n / ``ROWS`` times for each of its lists and yields at most about n links each time.
Of the short lists' pairs those are confirmed first that are some component's likeliest, then
what is still apart. No link between different components is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, WordHashes, by_batch, ngram_hashes, release, scratch, small_batches

SKETCH = 64
PREFIX = 16
HOT = 32
#: Members up to which a list is expanded into pairs.
LIST = 32
#: Rows and shingles of a block of a longer list (on average).
ROWS = 1024
CELLS = 1 << 20
#: Standard errors by which a union sketch's estimate may fall short.
SLACK = 6

SETS = "doc_id long, n long, set_key binary, sketch array<long>"


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. Only A-Z are lower-cased; words end at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(ngram_hashes(hashes.array(parts), words))


def _sets(words: int):
    def build():
        import hashlib

        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            n, keys, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, words, hashes)
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sketches.append(own[:SKETCH].view(np.int64))
            return {"doc_id": batch.column("doc_id"), "n": n, "set_key": keys, "sketch": sketches}

        return work

    return by_batch(build, {"doc_id": pa.int64(), "n": pa.int64(), "set_key": pa.binary(), "sketch": pa.list_(pa.int64())})


def _full_sets(words: int):
    """Of rows with a doc_id; those without words are left out."""

    def build():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            found = [(d, own.view(np.int64)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if len(own := shingle_set(t, words, hashes))]
            return {"doc_id": [d for d, _ in found], "full": [x for _, x in found]}

        return work

    return by_batch(build, {"doc_id": pa.int64(), "full": pa.list_(pa.int64())})


def _estimate(percent: int):
    """The share of the union's sketch that both have, null where the pair cannot reach ``percent``."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        s = percent / 100
        for x, nx, y, ny in zip(a, n, b, m, strict=True):
            whole = nx <= SKETCH and ny <= SKETCH
            low, times = np.unique(np.concatenate([x, y]).view(np.uint64), return_counts=True)
            times = times if whole else times[:SKETCH]
            share = (times == 2).mean()
            out.append(share if share >= s - (1e-12 if whole else SLACK * (s * (1 - s) / len(times)) ** 0.5) else None)
        return pd.Series(out, dtype=float)

    return estimate


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return linked


def _union_shares(mine: np.ndarray, theirs: np.ndarray, whole: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``theirs``, of the union of its sketch and ``mine``: the share that both have, and how many values it is taken of.

    Sketches are sorted ranks, padded with ``none``; where not ``whole`` only the union's ``SKETCH`` smallest count.
    """
    both = np.sort(np.concatenate([theirs, np.broadcast_to(mine, theirs.shape)], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < none)
    most = np.where(whole, 2 * SKETCH, SKETCH)
    rank = np.arange(2, 2 * SKETCH + 1, dtype=np.int16) - np.cumsum(twice, axis=1, dtype=np.int16)
    size = np.minimum((both < none).sum(axis=1) - twice.sum(axis=1), most)
    return (twice & (rank <= most[:, None])).sum(axis=1) / size, size


def _block_links(percent: int):
    """Links between the members of two blocks of a list (or within one), as a spanning forest."""
    s = percent / 100

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        here, low, high = key
        ids, block = frame["id"].to_numpy(), frame["part"].to_numpy()
        n = frame["full"].map(len).to_numpy()
        start = np.concatenate([[0], np.cumsum(n)])
        values, flat = np.unique(np.concatenate(frame["full"].to_numpy()).view(np.uint64), return_inverse=True)
        flat, none = flat.astype(np.int32), len(values)
        sketch = np.full((len(n), SKETCH), none, np.int32)
        for k in range(len(n)):
            own = flat[start[k] : start[k + 1]][:SKETCH]
            sketch[k, : len(own)] = own
        # each member's long lists as sorted numbers, padded with one that nobody has
        lists, number = np.unique(np.concatenate(frame["vs"].to_numpy()), return_inverse=True)
        on = np.full((len(n), max(map(len, frame["vs"]))), len(lists), np.int32)
        at = 0
        for k, vs in enumerate(frame["vs"]):
            on[k, : len(vs)] = np.sort(number[at : at + len(vs)])
            at += len(vs)
        this = int(np.searchsorted(lists, here))
        root = np.unique(ids, return_inverse=True)[1]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        has, listed, links = np.zeros(none, np.uint8), np.zeros(len(lists) + 1, bool), []
        for turn, i in enumerate(left):
            with_ = left[:turn] if low == high else right
            with_ = with_[(root[with_] != root[i]) & (np.minimum(n[with_], n[i]) * 100 >= np.maximum(n[with_], n[i]) * percent)]
            if not len(with_):
                continue
            listed[on[i]] = True
            listed[-1] = False
            common = listed[on[with_]]
            first = on[with_, np.argmax(common, axis=1)]
            listed[on[i]] = False
            with_ = with_[first == this]
            if not len(with_):
                continue
            whole = (n[with_] <= SKETCH) & (n[i] <= SKETCH)
            share, size = _union_shares(sketch[i], sketch[with_], whole, none)
            with_ = with_[share >= s - np.where(whole, 1e-12, SLACK * np.sqrt(s * (1 - s) / size))]
            if not len(with_):
                continue
            mine = flat[start[i] : start[i + 1]]
            has[mine] = 1
            cells = np.concatenate([flat[start[j] : start[j + 1]] for j in with_])
            shared = np.add.reduceat(has[cells], np.concatenate([[0], np.cumsum(n[with_])[:-1]]), dtype=np.int64)
            has[mine] = 0
            for j in with_[100 * shared >= percent * (n[i] + n[with_] - shared)]:
                if root[j] != root[i]:
                    links.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _long_list_links(lists: DataFrame, sizes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of each list in ``sizes`` (v, parts)."""
    blocks = sizes.agg(F.sum(F.expr("parts * (parts + 1) div 2"))).first()[0]
    if not blocks:
        return lists.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    tasks = min(int(blocks), max(200, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    member = lists.select("v", "id").distinct().join(sizes, "v").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    where = member.groupBy("id").agg(F.collect_list(F.struct("v", "part", "parts")).alias("lists"), F.sort_array(F.collect_set("v")).alias("vs"))
    wide = where.join(full.toDF("id", "full"), "id").select("id", "vs", "full", F.explode("lists").alias("x"))
    wide = wide.select("id", "vs", "full", "x.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [F.col("v"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    wide = wide.select(*keys, "id", "part", "vs", "full").repartition(tasks, "v", "low", "high")
    return wide.groupBy("v", "low", "high").applyInPandas(_block_links(percent), "a long, b long")


def _confirmed(labels: _Labels, pairs: Stored, full: DataFrame, percent: int) -> DataFrame:
    """The component pairs that ``pairs`` link by their full sets."""
    x, y = full.toDF("a", "fa"), full.toDF("b", "fb")
    found = Stored(pairs.df.join(x, "a").join(y, "b").where(_linked(percent)("fa", "fb")).select("a", "b"), "found").df
    pairs.drop()
    return labels.between(found).select(F.col("x").alias("a"), F.col("y").alias("b"))


class _Labels:
    """Components as a stored table (id, label); ids that it lacks are their own label."""

    def __init__(self, spark):
        self.kept = Stored(spark.createDataFrame([], "id long, label long"), "labels")

    def of(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """``df`` with the label of ``column``."""
        got = self.kept.df.select(F.col("id").alias(column), F.col("label").alias("_l"))
        return df.join(got, column, "left").withColumn(to, F.coalesce("_l", column)).drop("_l")

    def between(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) with their labels x and y, without those that have the same."""
        return self.of(self.of(pairs, "a", "x"), "b", "y").where("x <> y")

    def merge(self, edges: DataFrame) -> None:
        """Unites what ``edges`` (a, b: labels) link.

        Each label hooks onto its smallest smaller neighbour, the chains this
        makes are halved until flat, and edges between what is left are
        contracted and treated likewise until none is left.
        """
        ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
        edge = Stored(edges.select(*ends).where("a <> b").distinct(), "edges")
        while not edge.df.isEmpty():
            up = Stored(edge.df.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"), F.lit(True).alias("moved")), "up")
            while not up.df.where("moved").isEmpty():
                above = up.df.select(F.col("id").alias("label"), F.col("label").alias("_t"))
                step = up.df.select("id", "label").join(above, "label", "left")
                step = Stored(step.select("id", F.coalesce("_t", "label").alias("label"), F.col("_t").isNotNull().alias("moved")), "up")
                up.drop()
                up = step
            root = up.df.select(F.col("id").alias("mid"), F.col("label").alias("_t"))
            known = self.kept.df.select("id", F.col("label").alias("mid")).join(root, "mid", "left").select("id", F.coalesce("_t", "mid").alias("label"))
            labels = Stored(known.unionByName(up.df.select("id", "label")), "labels")
            rest = edge.df.join(root.toDF("a", "_a"), "a", "left").join(root.toDF("b", "_b"), "b", "left")
            rest = rest.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
            rest = Stored(rest.select(*ends).distinct(), "edges")
            for x in (self.kept, up, edge):
                x.drop()
            self.kept, edge = labels, rest
        edge.drop()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """See ``_near_duplicates``; all work is done when this returns, and of the tables written for it only the result's is left."""
    with small_batches(docs.sparkSession), scratch() as kept:
        found = Stored(_near_duplicates(docs, percent, words), "near")
        kept.append(found)
    return found.df


def _near_duplicates(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets. component_id is the smallest doc_id reachable; kept marks the
    row whose doc_id that is. A text of fewer than ``words`` words is one
    shingle; a null, empty or blank text has an empty set and stands alone. Rows
    that repeat a doc_id are one document: it links what any of them links. Rows
    without a doc_id form no links: their component is null and kept is false. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = Stored(base.mapInArrow(_sets(words), SETS), "sets")
    classes = sets.df.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = Stored(classes, "classes")
    first = sets.df.where("n > 0").join(classes.df.toDF("set_key", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    reps = Stored(first.select(F.col("doc_id").alias("id"), "n", "sketch"), "reps")

    # a value is hot if many sketches' first half has it
    values = reps.df.select("id", "n", F.explode(F.slice("sketch", 1, 2 * PREFIX)).alias("v"))
    hot = Stored(values.groupBy("v").count().where(F.col("count") > HOT).select("v"), "hot")
    need = F.least(F.lit(PREFIX), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    # each document's own few values in hash order (unsigned), hot ones last
    marked = values.join(hot.df.withColumn("h", F.lit(1)), "v", "left")
    order = F.struct(F.coalesce("h", F.lit(0)).alias("h"), F.col("v").bitwiseXOR(F.lit(-(2**63))).alias("o"), "v")
    listed = marked.groupBy("id", "n").agg(F.array_sort(F.collect_list(order)).alias("vs"))
    lists = Stored(listed.select("id", "n", F.explode(F.slice("vs", F.lit(1), need)).alias("x")).select("id", "n", F.col("x.v").alias("v")), "lists")
    sizes = lists.df.groupBy("v").agg(F.count("*").alias("c"), F.sum("n").alias("cells"), F.min("id").alias("low"), F.max("id").alias("high"))
    sizes = Stored(sizes.where("low < high").select("v", "c", F.ceil(F.greatest(F.col("c") / ROWS, F.col("cells") / CELLS)).cast("int").alias("parts")), "sizes")
    short = lists.df.join(sizes.df.where(F.col("c") <= LIST).select("v"), "v", "left_semi").select("v", "id", "n")
    long = sizes.df.where(F.col("c") > LIST).select("v", "parts")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = short.toDF("v", "a", "n").join(short.toDF("v", "b", "m"), "v").where(near & F.expr("a < b")).select("a", "b").distinct()
    mine, theirs = reps.df.select("id", "n", "sketch").toDF("a", "n", "sa"), reps.df.select("id", "n", "sketch").toDF("b", "m", "sb")
    scored = pairs.join(mine, "a").join(theirs, "b").select("a", "b", _estimate(percent)("sa", "n", "sb", "m").alias("e")).where("e is not null")
    likely = Stored(scored, "likely")
    listed = lists.df.join(long, "v", "left_semi").select("id")
    wanted = Stored(likely.df.select(F.explode(F.array("a", "b")).alias("doc_id")).union(listed).distinct(), "wanted")
    full = base.join(wanted.df, "doc_id", "left_semi").mapInArrow(_full_sets(words), "doc_id long, full array<long>")
    twice = sets.df.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not twice.limit(1).isEmpty():
        full = full.dropDuplicates(["doc_id", "full"])
    full = Stored(full, "full").df
    release(spark)

    labels = _Labels(spark)
    # a doc_id that stands on several rows links their sets
    again = sets.df.where("n > 0").groupBy("doc_id").agg(F.min("set_key").alias("k"), F.max("set_key").alias("l")).where("k <> l")
    again = sets.df.where("n > 0").join(again.select("doc_id"), "doc_id", "left_semi").join(classes.df, "set_key")
    labels.merge(again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = Stored(_long_list_links(lists.df, long, full, percent), "found").df
    labels.merge(labels.between(found).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # first the likeliest pair of each component, then what is still apart
    open_ = Stored(labels.between(likely.df), "between")
    each = open_.df.select(F.explode(F.array("x", "y")).alias("one"), F.struct("e", "a", "b").alias("p"))
    best = each.groupBy("one").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
    labels.merge(_confirmed(labels, Stored(best, "chosen"), full, percent))
    apart = labels.between(open_.df.select("a", "b")).select("a", "b").distinct()
    labels.merge(_confirmed(labels, Stored(apart, "chosen"), full, percent))
    for t in (lists, hot, sizes, wanted, likely, open_):
        t.drop()
    release(spark)
    rows = sets.df.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(classes.df, "set_key", "left")
    rows = labels.of(rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))), "rep", "component_id")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
