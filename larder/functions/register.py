"""The scalar functions as SQL functions of a session; none of them runs Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(arguments) and the SQL of each.
FUNCTIONS = {
    "hamming(a bigint, b bigint) returns int": "bit_count(a ^ b)",
    "content_key(x binary) returns string": "substring(sha2(x, 256), 1, 32)",
    "to_db(x double) returns double": "case when x > 0 then round(greatest(-96.0, 20 * log10(x)), 2) else -96.0 end",
    "shard_path(k string) returns string": "case when length(k) >= 4 then concat(substring(k, 1, 2), '/', substring(k, 3, 2), '/', k, '.webp') end",
    "collapse(x string) returns string": r"substring(trim(regexp_replace(x, '\\s+', ' ')), 1, 500)",
    "vector_dot(a array<double>, b array<double>) returns double": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_norm(a array<double>) returns double": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "first_positive(a double, b double) returns double": "coalesce(nullif(a, 0), nullif(b, 0))",
    "duration_tag(x double) returns string": "case when x <= 2 then 'sfx' when x >= 30 then 'music' end",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in a session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
