"""The allele functions under SQL names, as expression-bodied functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_STRIPPED = "trim(a)"
_BODY = f"substring({_STRIPPED}, instr({_STRIPPED}, '*') + 1)"
_NULL = f"(a IS NULL OR {_STRIPPED} IN ('', 'NA', '-', 'nan', 'None', '.', 'na'))"
_PARTS = f"filter(split({_BODY}, ':'), x -> x <> '')"
_CUT = (f"slice({_PARTS}, 1, coalesce(nullif(array_position(transform({_PARTS}, x -> lower(trim(x))), "
        f"'new'), 0) - 1, 99))")

FUNCTIONS = {
    "two_field": ("STRING", f"IF({_NULL} OR instr({_BODY}, ':') = 0, NULL, substring_index({_BODY}, ':', 2))"),
    "allele_fields": ("ARRAY<STRING>", f"IF({_NULL} OR size({_CUT}) = 0, NULL, {_CUT})"),
    "allele_depth": ("INT", f"IF({_NULL} OR size({_CUT}) = 0, NULL, size({_CUT}))"),
    "allele_gene": ("STRING", "IF(instr(a, '*') > 0, substring_index(a, '*', 1), NULL)"),
    "release_name": ("STRING",
                     "CASE WHEN length(trim(a)) >= 4 THEN concat_ws('.', left(trim(a), length(trim(a)) - 3), "
                     "substring(trim(a), length(trim(a)) - 2, 2), right(trim(a), 1)) "
                     "WHEN length(trim(a)) = 3 THEN concat_ws('.', left(trim(a), 1), right(trim(a), 2), '0') "
                     "ELSE trim(a) END"),
}


def register(spark: SparkSession) -> None:
    for name, (kind, text) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING) RETURNS {kind} RETURN {text}")
