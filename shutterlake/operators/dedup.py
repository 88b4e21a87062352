"""Duplicate photos: equal files, equal names, and near perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.exprs import duplicate_base, hamming, hash_value, similarity

from .components import roots
from .scratch import Stored, scratch

PHASH_BITS, DHASH_BITS = 10, 8


def groups(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """One row for each member of a key that two or more rows share: key, member, size. Empty keys don't count."""
    keyed = rows.select(key.alias("key"), member).where("key is not null and key <> ''")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keyed.join(shared, "key")


def exact(rows: DataFrame, member: str = "ord") -> DataFrame:
    return groups(rows, F.col("file_hash"), member)


def by_filename(rows: DataFrame, member: str = "ord") -> DataFrame:
    return groups(rows, duplicate_base(F.col("filename")), member)


def from_hex(rows: DataFrame) -> DataFrame:
    """Parsed hashes; rows without any, or with one that isn't hex, are left out."""
    bad = lambda c: F.col(c).isNotNull() & hash_value(F.col(c)).isNull()
    kept = rows.where((F.col("phash").isNotNull() | F.col("dhash").isNotNull()) & ~bad("phash") & ~bad("dhash"))
    return kept.withColumns({"phash": hash_value(F.col("phash")), "dhash": hash_value(F.col("dhash"))})


#: Bands that a hash is cut into for the search of near ones.
BANDS = 4


def bands(c: Column, bits: int) -> Column:
    """Keys of a hash, one for each band and value, of which two hashes within ``bits`` share at least one.

    Among ``BANDS`` disjoint bands one differs in at most bits / BANDS places.
    Where that is one or two, each band stands with its variants of a single turned
    bit as well: two values two bits apart meet in the variant between them. Bands
    are then wide enough that rows that aren't near seldom meet.
    """
    if not 0 <= bits < 3 * BANDS:
        raise ValueError(f"bits must be from 0 to {3 * BANDS - 1}")
    edges = [64 * k // BANDS for k in range(BANDS + 1)]
    keys = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        turned = [0] + [1 << i for i in range(b - a)] * (bits >= BANDS)
        keys += [value.bitwiseXOR(F.lit((k << 32) + t)) for t in turned]  # the band's number lies above its value
    return F.array(*keys)


def classes(rows: DataFrame) -> DataFrame:
    """Equal pairs of hashes as one row: phash, dhash and rep, the smallest id that has them."""
    return rows.groupBy("phash", "dhash").agg(F.min("id").alias("rep"))


def class_links(found: DataFrame, phash_bits: int = PHASH_BITS, dhash_bits: int = DHASH_BITS) -> DataFrame:
    """Pairs a < b of representatives of ``classes`` with either hash within reach: a, b, pd, dd. Candidates share a band's value.

    Keys are many times the rows that they come from, which Spark's sizes don't show;
    the hint keeps them from being collected and broadcast.
    """
    near = []
    for name, bits in (("phash", phash_bits), ("dhash", dhash_bits)):
        one = found.where(F.col(name).isNotNull()).select(F.col("rep").alias("a"), "phash", "dhash", F.explode(bands(F.col(name), bits)).alias("key"))
        other = one.select(F.col("a").alias("b"), F.col("phash").alias("p2"), F.col("dhash").alias("d2"), "key")
        reach = hamming(F.col(name), F.col("p2" if name == "phash" else "d2")) <= bits
        near.append(one.join(other.hint("merge"), "key").where((F.col("a") < F.col("b")) & reach).select("a", "b", hamming(F.col("phash"), F.col("p2")).alias("pd"), hamming(F.col("dhash"), F.col("d2")).alias("dd")))
    return near[0].unionByName(near[1]).distinct()


def members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row's representative: id, rep, and the distances pd, dd of two rows of its class."""
    both = rows.alias("r").join(found.alias("c"), F.col("r.phash").eqNullSafe(F.col("c.phash")) & F.col("r.dhash").eqNullSafe(F.col("c.dhash")))
    own = lambda name: hamming(F.col(f"c.{name}"), F.col(f"c.{name}"))
    return both.select("id", "rep", own("phash").alias("pd"), own("dhash").alias("dd"))


def hashed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("phash").isNotNull() | F.col("dhash").isNotNull())


def hamming_pairs(rows: DataFrame, phash_bits: int = PHASH_BITS, dhash_bits: int = DHASH_BITS) -> DataFrame:
    """All pairs a < b of ids with either hash (phash, dhash: bigint) within reach: a, b, pd, dd.

    Classes of equal hashes are compared, and expanded at the end: n equal pictures
    have n * n / 2 pairs. ``perceptual`` works on classes and doesn't expand them.
    """
    rows = hashed(rows)
    found = classes(rows)
    links = class_links(found, phash_bits, dhash_bits)
    member = members(rows, found)
    one, other = member.select(F.col("id").alias("x"), F.col("rep").alias("a")), member.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(one, "a").join(other, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "pd", "dd")
    within = member.join(other, F.col("rep") == F.col("b")).where("id < y").select(F.col("id").alias("a"), F.col("y").alias("b"), "pd", "dd")
    return across.unionByName(within)


#: Components with more edges are walked in rounds; others in one pass each.
WALK_EDGES = 1_000_000


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy walks through components whose edges come together, sorted by b and a. Holds the captured rows of one component."""
    component, row, captured = None, None, set()
    for batch in batches:
        out = []
        for c, b, a in zip(batch["root"].tolist(), batch["b"].tolist(), batch["a"].tolist(), strict=True):
            if c != component:
                component, row, captured = c, None, set()
            if b != row and a not in captured:  # a's own edges came before
                out.append((b, a))
                captured.add(b)
                row = b
        yield pd.DataFrame(out, columns=["member", "seed"])


def _rounds(edges: DataFrame) -> DataFrame:
    """Each round decides the rows whose earlier neighbours are all decided or include a seed."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    state = Stored(nodes.select("id", F.lit(None).cast("boolean").alias("is_seed")), "state")
    while not state.df.where("is_seed is null").isEmpty():
        below = edges.join(state.df.toDF("a", "s"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("s", F.lit(False))).alias("caught"), F.bool_and(F.col("s").isNotNull()).alias("known"))
        new = F.when(F.col("is_seed").isNotNull(), F.col("is_seed")).when(F.coalesce("caught", F.lit(False)), F.lit(False)).when(F.coalesce("known", F.lit(True)), F.lit(True))
        later = Stored(state.df.join(below, "id", "left").select("id", new.alias("is_seed")), "state")
        state.drop()
        state = later
    seeds = state.df.where("is_seed").select(F.col("id").alias("a"))
    caught = state.df.where("not is_seed").select(F.col("id").alias("b"))
    return edges.join(seeds, "a").join(caught, "b").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("seed"))


def stars(pairs: DataFrame) -> DataFrame:
    """Greedy star clusters over pairs a < b (long) in the order of ids: member, seed.

    A row is a seed if no earlier neighbour is one, and is captured by its
    smallest neighbouring seed otherwise. Components of up to ``WALK_EDGES`` edges
    are walked each in one pass, many to a task; larger ones in rounds.
    """
    with scratch() as kept:
        edges = Stored(pairs.select("a", "b"), "pairs").df
        # a row's larger neighbours stand in the component of its own root
        root = roots(edges).df.toDF("root", "b")
        placed = Stored(edges.join(root, "b").select("root", "b", "a"), "placed").df
        large = Stored(placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > WALK_EDGES).select("root"), "large").df
        some = not large.isEmpty()
        small = placed.join(large, "root", "left_anti") if some else placed
        out = small.distinct().repartition("root").sortWithinPartitions("root", "b", "a").mapInPandas(_walked, "member long, seed long")
        if some:
            out = out.unionByName(_rounds(Stored(placed.join(large, "root").select("a", "b"), "long").df))
        result = Stored(out, "stars")
        kept.append(result)
    return result.df


def perceptual(rows: DataFrame, in_exact: DataFrame | None = None) -> DataFrame:
    """Star clusters with each member's likeness to its seed: seed, member, similarity, match_on. Groups that lie wholly among ``in_exact`` (id) go.

    Stars are found among classes of equal hashes: a row has the seed of its class,
    whose smallest row comes before it and has the same neighbours. So n copies of
    one picture cost n rows and no pairs.
    """
    rows = hashed(rows)
    with scratch() as kept:
        found = Stored(classes(rows), "classes").df
        links = Stored(class_links(found), "links").df
        own = Stored(stars(links), "own").df
        near = own.join(links, (F.col("seed") == F.col("a")) & (F.col("member") == F.col("b"))).select("seed", F.col("member").alias("rep"), F.col("pd").alias("pd2"), F.col("dd").alias("dd2"))
        placed = members(rows, found).join(near, "rep", "left")
        distance = {c: F.coalesce(f"{c}2", c) for c in ("pd", "dd")}  # to the seed; rows of the seed's own class are as far as equal hashes
        seed = F.coalesce("seed", "rep")
        match = F.when(seed == F.col("id"), "seed").when(distance["dd"] < distance["pd"], "dhash").otherwise("phash")
        out = placed.select(seed.alias("seed"), F.col("id").alias("member"), similarity(distance["pd"], distance["dd"]).alias("similarity"), match.alias("match_on"))
        groups = out.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
        result = Stored(out.join(groups, "seed"), "groups")
        kept.append(result)
    return result.df if in_exact is None else outside(result.df, in_exact)


def outside(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """``groups`` (seed, member, ...) without those whose members all are among ``ids`` (id)."""
    marked = groups.join(ids.select(F.col("id").alias("member"), F.lit(True).alias("_in")).distinct(), "member", "left")
    wholly = marked.groupBy("seed").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("all")).where("all").select("seed")
    return groups.join(wholly, "seed", "left_anti")


def summary(rows: DataFrame, same: DataFrame, named: DataFrame, near: DataFrame) -> DataFrame:
    """One row: how many groups of each kind, of all kinds, and how many rows were looked at."""
    count = lambda df, key, name: df.select(key).distinct().agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    out = rows.agg(F.count("*").alias("scanned")).withColumn("k", F.lit(1))
    for df, key, name in ((same, "key", "exact_groups"), (named, "key", "filename_groups"), (near, "seed", "perceptual_groups")):
        out = out.join(F.broadcast(count(df, key, name)), "k")  # one row each
    return out.drop("k").withColumn("total_groups", F.col("exact_groups") + F.col("filename_groups") + F.col("perceptual_groups"))


#: Best first.
STATUS_ORDER = ("gps", "named", "history", "inferred", "unknown")


def best_copies(members: DataFrame, group: str, status: str, size: str, member: str) -> DataFrame:
    """``members`` with keep: of each group the best status, then the largest, then the smallest id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col(status)), F.lit(0)), F.lit(99))
    best = members.groupBy(group).agg(F.min(F.struct(place.alias("p"), (-F.col(size)).alias("s"), F.col(member).alias("m"))).alias("_best"))
    return members.join(best, group).withColumn("keep", F.col(member) == F.col("_best.m")).drop("_best")
