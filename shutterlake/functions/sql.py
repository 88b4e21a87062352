"""The library's rules as functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name and body of each; bodies are SQL alone, so Catalyst puts them in place of the call.
FUNCTIONS = {
    "is_junk_desc(text STRING) RETURNS BOOLEAN": "coalesce(trim(text) = '' OR trim(text) RLIKE '(?i)^[a-z0-9 ]+ digital camera$', true)",
    "real_position(lat DOUBLE, lon DOUBLE) RETURNS BOOLEAN": "coalesce(abs(lat) > 1e-6 OR abs(lon) > 1e-6, false)",
    "hamming64(a BIGINT, b BIGINT) RETURNS INT": "coalesce(bit_count(a ^ b), 99)",
}


def register(spark: SparkSession) -> None:
    """``FUNCTIONS`` for this session; made again, they are replaced."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_track(spark: SparkSession, points: DataFrame, name: str = "track") -> None:
    """A table function over ``points`` (import_id, us, lat, lon): name(import, first, last) gives an import's points between two times in microseconds, both inclusive, null for no bound."""
    points.createOrReplaceTempView(f"{name}_points")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(of BIGINT, first BIGINT, last BIGINT) RETURNS TABLE (us BIGINT, lat DOUBLE, lon DOUBLE) "
        f"RETURN SELECT us, lat, lon FROM {name}_points WHERE import_id = {name}.of AND us >= coalesce({name}.first, us) AND us <= coalesce({name}.last, us)"
    )
