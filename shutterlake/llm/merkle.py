"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks, as DataFrame expressions.

A text falls into sections (between blank lines), these into paragraphs (lines)
and these into blocks of at most ``BLOCK`` code points. A block's hash is that of
its characters; a paragraph's, section's and the text's hash are those of the
list of hashes below, with their number. Roots test equality; comparing the
branches of two trees from the top leads to the paragraphs that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 48
#: Rows of a range of ids; ranges are the units that neighbours are found within.
RANGE_ROWS, RANGES = 200, 65_536


def tree(text: Column) -> Column:
    """sections: array of paragraphs: array of block hashes (16 hex digits). Null counts as empty."""
    block = lambda b: F.substring(F.md5(b.cast("binary")), 1, 16)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), 0), block)
    section = lambda s: F.transform(F.split(s, "\n"), paragraph)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def _digest(parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(",", parts).cast("binary")), 1, 16)


def paragraph_hashes(of: Column) -> Column:
    return F.transform(of, lambda s: F.transform(s, _digest))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, _digest)


def root(sections: Column) -> Column:
    return F.sha2(F.concat_ws(",", sections).cast("binary"), 256)


def fingerprint(of: Column) -> Column:
    """root/section:paragraph.paragraph/section:... in hex; equal exactly if the texts are."""
    paragraphs = paragraph_hashes(of)
    sections = section_hashes(paragraphs)
    branches = F.transform(paragraphs, lambda p: F.concat(_digest(p), F.lit(":"), F.concat_ws(".", p)))
    return F.concat(root(sections), F.lit("/"), F.concat_ws("/", branches))


def leaves(of: Column) -> Column:
    """The distinct block hashes; an empty paragraph has none, an empty text one of its own."""
    flat = F.array_distinct(F.flatten(F.flatten(of)))
    return F.when(F.size(flat) > 0, flat).otherwise(F.array(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Common share of two trees' blocks, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with root, sections, paragraphs and fingerprint; a null text counts as empty."""
    out = docs.select("doc_id", tree(F.col("text")).alias("_t"))
    paragraphs = paragraph_hashes(F.col("_t"))
    return out.select("doc_id", root(section_hashes(paragraphs)).alias("root"), section_hashes(paragraphs).alias("sections"), paragraphs.alias("paragraphs"), fingerprint(F.col("_t")).alias("fingerprint"))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph) places, from 0, at which two ``paragraphs`` columns differ; descends only into sections whose lists differ."""
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)

    def inside(i: Column) -> Column:
        x, y = F.coalesce(F.get(a, i), F.array().cast("array<string>")), F.coalesce(F.get(b, i), F.array().cast("array<string>"))
        lines = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.transform(lines, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    changed = F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.flatten(F.transform(changed, inside))


def _place(bounds: Column, value: Column, n: int) -> Column:
    """The last of ``n`` sorted bounds that is at most ``value``, 0 where none is or where it is null: by halving steps."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step) <= value, at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column>: the row that follows in the order of doc_id (then of ``columns``); the first follows the last.

    Rows move once, into ranges of ids with about RANGE_ROWS rows (more if the
    table needs over RANGES ranges). A range begins at an id that the table has,
    and rows of that id also go to the range before, whose last row they follow.
    """
    n = docs.count()
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    shares = ", ".join(str(k / ranges) for k in range(ranges)) if ranges > 1 else "0.0"
    edges = docs.agg(F.min("doc_id").alias("low"), F.expr(f"percentile_approx(doc_id, array({shares}), 10000)").alias("edges")).first()
    bounds = sorted({edges["low"], *(edges["edges"] or [])} - {None}) or [0]
    place = lambda r, late: F.struct(r.alias("r"), F.lit(late).alias("late"))
    own, first = place(F.col("_r"), 0), F.lit(True)
    out = docs.withColumn("_bounds", F.from_json(F.lit(str(bounds)), "array<bigint>"))
    out = out.withColumn("_r", _place(F.col("_bounds"), F.col("doc_id"), len(bounds)))
    if len(bounds) > 1:
        first = F.coalesce(F.get("_bounds", F.col("_r")) == F.col("doc_id"), F.lit(False))
    before = place(F.pmod(F.col("_r") - 1, F.lit(len(bounds))), 1)
    goes = F.when(first, F.array(own, before)).otherwise(F.array(own))
    out = out.withColumn("_to", F.explode(goes)).select(*docs.columns, F.col("_to.r").alias("_r"), F.col("_to.late").alias("_late"))
    order = Window.partitionBy("_r").orderBy("_late", "doc_id", *columns)
    return out.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {"_late": F.col("_late")}).where("_late = 0").drop("_late", "_r")


def compared(docs: DataFrame) -> DataFrame:
    """For each row: fingerprints of its text and of its edited text, and how alike its fingerprint is to that and to the next document's.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many, or all, of the next document's text. A null text counts as empty;
    two empty texts are alike. Rows that repeat a doc_id follow each other in
    the order of their texts; rows without one come first. Other columns are
    ignored, an empty table gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_next(base, ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.col("text")), F.lit(1), half))
    out = out.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), leaves(tree(F.coalesce("next_text", F.col("text")))).alias("next_leaves"))
    out = out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("t")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), leaves(F.col("t")).alias("a"), leaves(F.col("e")).alias("b"), "next_leaves")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_leaves")).alias("near_next"))
