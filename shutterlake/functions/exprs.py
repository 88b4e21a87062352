"""Scalar rules as Spark column expressions; none of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file suffixes that count as photos.
EXTENSIONS = ("jpg", "jpeg", "cr2", "nef", "arw", "orf", "rw2", "dng")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def junk_description(c: Column) -> Column:
    """Nothing, blanks, or a camera's default text."""
    text = F.trim(c)
    return F.coalesce((text == "") | text.rlike("(?i)^[a-z0-9 ]+ digital camera$"), F.lit(True))


def real_position(lat: Column, lon: Column) -> Column:
    """False at the point where both coordinates are nought."""
    return F.coalesce((F.abs(lat) > 1e-6) | (F.abs(lon) > 1e-6), F.lit(False))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def rational(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def decimal_to_dms(value: Column, north: str, south: str) -> dict[str, Column]:
    """Degrees, minutes, hundredths of seconds (rounded half to even, not carried) and the hemisphere."""
    size = F.abs(value)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return {"deg": d, "min": m, "sec100": F.bround(((size - d) * 60 - m) * 60 * 100, 0).cast("long"), "ref": F.when(value >= 0, F.lit(north)).otherwise(F.lit(south))}


def minutes(micros: Column) -> Column:
    """Whole minutes, halves to even."""
    return F.bround(micros / 60_000_000, 0).cast("long")


def plain_number(c: Column) -> Column:
    """A number in six significant digits without trailing noughts, rounded by its exact value, halves to even; with an exponent below 1e-4 and from 1e6 on."""
    c = c.cast("double")
    as_ = lambda pattern: F.call_function("format_number", c, F.lit(pattern))
    parts = F.split(as_("0.#####E0"), "E")
    power = parts[1].cast("int")
    plain = F.when(power == -4, as_("0.#########"))
    for k in range(-3, 6):
        plain = plain.when(power == k, as_("0." + "#" * (5 - k) if k < 5 else "0"))
    sign = F.when(power < 0, "e-").otherwise("e+")
    digits = F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string"))
    return F.when((power >= -4) & (power < 6), plain).otherwise(F.concat(parts[0], sign, digits))


def aperture_text(c: Column) -> Column:
    return F.concat(F.lit("f/"), plain_number(c))


def focal_text(c: Column) -> Column:
    return F.concat(plain_number(c), F.lit("mm"))


def shutter_text(num: Column, den: Column) -> Column:
    whole = lambda c: c.cast("long").cast("string")
    text = F.when(num < den, F.concat(whole(num), F.lit("/"), whole(den), F.lit("s"))).otherwise(F.concat(plain_number(num / den), F.lit("s")))
    return F.when((num != 0) & (den != 0), text)


def camera_name(make: Column, model: Column) -> Column:
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    both = F.trim(F.concat_ws(" ", make, model))
    name = F.when((make != "") & (model != "") & F.startswith(F.lower(model), F.lower(make)), model).otherwise(both)
    return F.when(name != "", name)


def exif_date(*tags: Column) -> Column:
    """Of the first tag that is there, even if it can't be read."""
    return F.try_to_timestamp(F.coalesce(*tags), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def taken(own: Column, modified: Column, changed: Column) -> dict[str, Column]:
    """A photo's date and where it is from: its own, or else the earlier of its file's times (seconds, UTC)."""
    file = F.timestamp_seconds(F.least(modified, changed)).cast("timestamp_ntz")
    return {"date_taken": F.coalesce(own, file), "date_source": F.when(own.isNotNull(), "exif").when(file.isNotNull(), "filesystem")}


def iso_time(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def duplicate_base(filename: Column) -> Column:
    """The name without a copy's number, in lower case."""
    return F.lower(F.regexp_replace(filename, r"^(.+?)(\s*\(\d+\))(\.[^.]+)$", "$1$3"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, "[^A-Za-z0-9._ -]", "")), r"\s+", "_")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+$", "")


def renamed(template: Column, tokens: dict[str, Column], ext: Column) -> Column:
    """Tokens filled in one after the other, runs of separators made one underscore, the suffix put on unless it is there."""
    out = template
    for name, value in tokens.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    out = F.btrim(F.regexp_replace(out, "[_ -]{2,}", "_"), F.lit("_ -"))
    return F.when(F.endswith(F.lower(out), F.lower(ext)), out).otherwise(F.concat(out, ext))


def hash_value(hex_text: Column) -> Column:
    """A 64-bit hash from up to sixteen hex digits; null if it isn't one."""
    good = hex_text.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, F.conv(F.when(good, hex_text), 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 99 if a hash is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(99))


def similarity(pd: Column, dd: Column) -> Column:
    return F.bround((1 - F.least(pd, dd) / 64) * 100, 0).cast("int")


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def place_name(address: dict[str, Column], display: Column) -> Column:
    town = F.coalesce(*(F.nullif(address[k], F.lit("")) for k in ("city", "town", "village", "municipality", "county")))
    text = F.concat_ws(", ", town, F.nullif(address["country"], F.lit("")))
    return F.when(text != "", text).otherwise(display)


def sanitised_answer(answer: Column, seed: Column, refusals: tuple[str, ...]) -> Column:
    text = F.lower(answer)
    refused = F.lit(False)
    for phrase in refusals:
        refused = refused | F.contains(text, F.lit(phrase))
    return F.when((F.length(answer) > 60) | refused | answer.isNull(), seed).otherwise(answer)


def tolerance_minutes(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(c.try_cast("int"), F.lit(60)))


def rotation(c: Column, ext: Column) -> Column:
    """Degrees of a turn, for JPEG files only."""
    return F.when(F.lower(ext).isin(".jpg", ".jpeg"), F.pmod(c, F.lit(360)))


def scan_status(has_gps: Column, name: Column) -> Column:
    return F.when(has_gps, F.lit("gps")).when(~blank(name), F.lit("named")).otherwise(F.lit("unknown"))


def saved_status(lat: Column, lon: Column, name: Column) -> Column:
    return F.when(F.coalesce((lat != 0) & (lon != 0), F.lit(False)), F.lit("gps")).when(~blank(name), F.lit("named")).otherwise(F.lit("unknown"))
