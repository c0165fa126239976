"""Allele names: GENE*f1:f2:f3:f4, one to four colon fields, optional gene prefix.

Everything is built from position, substring and split calls on whole columns, so a scan of
billions of calls stays inside one generated loop. The rare shapes (doubled colons, a "new"
token) are behind a cheap containment test, so the regular expression runs only for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haplodeck.functions.text import col, is_null_token, strip


def strip_star(c: Column | str) -> Column:
    """Everything after the first star; the text itself when it has none."""
    text = col(c)
    return F.substr(text, F.instr(text, "*") + 1)


def gene_of(c: Column | str) -> Column:
    text = col(c)
    return F.when(F.instr(text, "*") > 0, F.substring_index(text, "*", 1))


def bare_gene(c: Column | str, prefix: str = "HLA-") -> Column:
    return F.when(F.startswith(col(c), F.lit(prefix)), F.substr(col(c), F.lit(len(prefix) + 1))).otherwise(col(c))


def _colons(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))


def truncate_fields(c: Column | str, n: int, any_case: bool = False) -> Column:
    """First n fields, null for a null token and for calls with fewer fields. Empty fields count."""
    body = strip_star(strip(c))
    deep_enough = _colons(body) >= n - 1
    return F.when(~is_null_token(c, any_case) & deep_enough, F.substring_index(body, ":", n))


def two_field(c: Column | str, any_case: bool = False) -> Column:
    return truncate_fields(c, 2, any_case)


def allele_group(c: Column | str) -> Column:
    """First field of an already normalised name."""
    return F.substring_index(col(c), ":", 1)


def raw_depth(c: Column | str) -> Column:
    """Number of colon fields of the raw text, null when blank."""
    text = col(c)
    return F.when(strip(text) != "", _colons(text) + 1)


def clean_fields(c: Column | str, cut_new: bool = True) -> Column:
    """Colon text without prefix and empty fields, cut at the first "new" field; null if empty."""
    body = strip_star(strip(c))
    body = F.when(
        F.contains(body, F.lit("::")), F.regexp_replace(body, ":{2,}", ":")
    ).otherwise(body)
    body = F.trim(body, F.lit(":"))
    if cut_new:
        cut = F.regexp_replace(F.concat(F.lit(":"), body), r"(?i):\s*new\s*(:.*)?$", "")
        body = F.when(
            F.contains(F.lower(body), F.lit("new")), F.trim(cut, F.lit(":"))
        ).otherwise(body)
    return F.when(~is_null_token(c) & (body != ""), body)


def field_list(c: Column | str, cut_new: bool = True) -> Column:
    return F.split(clean_fields(c, cut_new), ":")


def depth(c: Column | str, cut_new: bool = True) -> Column:
    return _colons(clean_fields(c, cut_new)) + 1


def resolved(a: Column | str, b: Column | str, cut_new: bool = True) -> Column:
    """Both haplotypes hold a parseable call."""
    return clean_fields(a, cut_new).isNotNull() & clean_fields(b, cut_new).isNotNull()


def unordered_pair(a: Column, b: Column) -> Column:
    """One comparable text per unordered pair; null when either side is null."""
    return F.when(a <= b, F.concat(a, F.lit("|"), b)).otherwise(F.concat(b, F.lit("|"), a))


def decode_release(c: Column | str) -> Column:
    """'3650' -> '3.65.0', '116' -> '1.16.0'; other lengths stay as they are."""
    code = strip(c)
    n = F.length(code)
    four = F.concat_ws(
        ".", F.substr(code, F.lit(1), n - 3), F.substr(code, n - 2, F.lit(2)), F.right(code, F.lit(1))
    )
    three = F.concat_ws(".", F.substr(code, F.lit(1), n - 2), F.right(code, F.lit(2)), F.lit("0"))
    return F.when(n >= 4, four).when(n == 3, three).otherwise(code)


def dosage(a1: Column | str, a2: Column | str, allele: Column | str) -> Column:
    """Copies (0, 1, 2) of a two-field allele; null when either haplotype is uncallable."""
    k1, k2 = two_field(a1, any_case=True), two_field(a2, any_case=True)
    want = F.lit(allele) if isinstance(allele, str) else allele
    copies = (k1 == want).cast("int") + (k2 == want).cast("int")
    return F.when(k1.isNotNull() & k2.isNotNull(), copies)
