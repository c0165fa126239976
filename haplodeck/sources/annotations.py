"""Annotation files (GTF): attributes per gene, calls per haplotype, completion by content.

A file is one person and haplotype. line_no orders its lines: by the place of the split, then by the
row inside it, so files that are read in several splits keep their order too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplodeck.functions import alleles as al
from haplodeck.functions.text import col
from haplodeck.operators.rows import with_once
from haplodeck.sources.callers import path_part

#: One attribute: everything up to a semicolon that is not inside quotes.
FIELD = r'[^;"]*(?:"[^"]*"[^;"]*)*'
#: The same without giving back, for texts whose quotes all close.
_PLAIN_FIELD = r'[^;"]*+(?:"[^"]*+"[^;"]*+)*+'
#: Longest text that is searched field by field inside one expression.
_PLAIN_LENGTH = 2000
PERSON = r"/([^/]+)/[^/]+/[^/]+$"
HAP = r"/(hap[12])[^/]*$"


def attributes(c: Column | str) -> Column:
    """array of (key, value, quoted): each attribute is cut at its first blank; a quoted value is what
    stands between its quotes."""
    fields = F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(FIELD), F.lit(0)), lambda f: F.trim(f)),
                      lambda f: F.contains(f, F.lit(" ")))

    def one(f: Column) -> Column:
        rest = F.trim(F.substring(f, F.locate(" ", f), F.length(f)))
        quoted = F.startswith(rest, F.lit('"'))
        return F.struct(
            F.split_part(f, F.lit(" "), F.lit(1)).alias("key"),
            F.when(quoted, F.split_part(rest, F.lit('"'), F.lit(2))).otherwise(rest).alias("value"),
            quoted.alias("quoted"))

    return F.transform(fields, one)


def _plain(text: str) -> Column:
    """Short texts whose quotes all close: one expression per key finds what `attributes` would."""
    n = F.length(text)
    return (n <= _PLAIN_LENGTH) & ((n - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 0)


def _once(text: str, key: str) -> tuple[Column, Column]:
    """(value, unclear) of a key that stands once in a text, by plain searches. Unclear are texts where only
    `attributes` can tell: the key comes again or inside a value, a quote does not close, there is no value."""
    word, c = f"{key} ", F.col(text)
    before = F.when(F.contains(c, F.lit(word)), F.substring_index(c, word, 1))
    after = F.substr(c.cast("binary"), F.octet_length(before) + len(word.encode()) + 1).cast("string")  # by bytes
    head, rest = F.rtrim(before), F.ltrim(after)
    outside = (F.octet_length(head) - F.octet_length(F.replace(head, F.lit('"'), F.lit("")))) % 2 == 0
    quoted, closed, bare = F.startswith(rest, F.lit('"')), F.substring_index(rest, '"', 2), F.rtrim(F.substring_index(rest, ";", 1))
    whole = (quoted & (F.octet_length(closed) < F.octet_length(rest))) | (
        ~quoted & ~F.contains(bare, F.lit('"')) & (bare != ""))
    # no part of it is conditional, so that each is computed once per row; null where the key is missing
    found = ~F.contains(after, F.lit(word)) & ((head == "") | F.endswith(head, F.lit(";"))) & outside & whole
    return F.when(found, F.when(quoted, F.substr(closed, F.lit(2))).otherwise(bare)), ~found


def _last(text: str, key: str) -> Column:
    """Value of the key's last attribute."""
    rest = F.rtrim(F.regexp_extract(text, f"^(?:{_PLAIN_FIELD};)* *+{re.escape(key)} ++(?=[^;])({_PLAIN_FIELD})", 1))
    plain = F.when(F.startswith(rest, F.lit('"')), F.split_part(rest, F.lit('"'), F.lit(2))).when(rest != "", rest)
    return F.when(_plain(text), plain).otherwise(
        F.try_element_at(F.filter(attributes(text), lambda a: a["key"] == key), F.lit(-1))["value"])


def _quoted(text: str, key: str) -> Column:
    """First value in quotes that is not empty."""
    plain = F.nullif(F.regexp_extract(
        text, f'^(?:{_PLAIN_FIELD};)*? *+{re.escape(key)} ++"([^"]++)"', 1), F.lit(""))
    return F.when(_plain(text), plain).otherwise(F.get(F.filter(
        attributes(text), lambda a: (a["key"] == key) & a["quoted"] & (a["value"] != "")), F.lit(0))["value"])


def with_last(lines: DataFrame, text: str, named: dict[str, str]) -> DataFrame:
    """Adds for each name the value of a key's last attribute; the slow ways are taken only for unclear texts, and
    kept out of the plain searches' generated method."""
    parts = {n: _once(text, key) for n, key in named.items()}
    quick = with_once(lines, {f"{n}_{i}": p[i] for n, p in parts.items() for i in (0, 1)})
    return quick.select(*lines.columns, *[
        F.when(F.col(f"{n}_1"), _last(text, key)).otherwise(F.col(f"{n}_0")).alias(n) for n, key in named.items()])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (person_id, hap, line_no, value) -> with their attribute list; comments and rows of
    fewer than nine columns left out."""
    real = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return with_once(real, {"text": F.get(F.split("value", "\t"), F.lit(8))}).where("text is not null").select(
        "person_id", "hap", "line_no", "text", attributes("text").alias("attrs"))


def read_lines(spark: SparkSession, glob: str, person: str = PERSON, hap: str = HAP) -> DataFrame:
    return spark.read.text(glob).select(
        path_part(person).alias("person_id"), path_part(hap).alias("hap"),
        F.struct(F.col("_metadata.file_block_start").alias("at"),
                 F.monotonically_increasing_id().alias("row")).alias("line_no"), "value")


def gene_attributes(parsed: DataFrame, names: list[str]) -> DataFrame:
    """Per person, haplotype and gene the first value of each wanted attribute over all rows; of a key
    that comes twice on a line the last counts. Rows that carry only a gene_id take the latest name
    that id was given at or before them."""
    where = ["person_id", "hap"]
    rows = with_last(parsed.select(*where, "line_no", "text"), "text", {
        "_gid": "gene_id", "_name": "gene_name", **{f"_v{i}": n for i, n in enumerate(names)}}).drop("text")
    # the rows of one gene id of one haplotype: a gene's lines, never more
    so_far = Window.partitionBy(*where, "_gid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_gid").isNotNull(), F.last("_name", ignorenulls=True).over(so_far))
    named = rows.withColumn("gene_name", F.coalesce("_name", known)).where(F.col("gene_name").isNotNull())
    held = [F.col(f"_v{i}") for i in range(len(names))]
    return named.where(F.coalesce(*held).isNotNull()).groupBy(
        *where, al.bare_gene("gene_name").alias("gene")).agg(*[
            F.min_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(n) for v, n in zip(held, names, strict=True)])


def gene_calls(parsed: DataFrame) -> DataFrame:
    """Per person, haplotype and gene the call of the last row that has one: the quoted consensus,
    else the quoted allele."""
    called = parsed.where(F.contains("text", F.lit("consensus")) | F.contains("text", F.lit("allele")))
    rows = with_once(called.select("person_id", "hap", "line_no", "text"), {
        "gene": F.coalesce(_quoted("text", "gene_name"), _quoted("text", "gene_id")),
        "call": F.coalesce(_quoted("text", "consensus"), _quoted("text", "allele")),
    }).where(F.col("gene").isNotNull() & F.col("call").isNotNull())
    return rows.groupBy("person_id", "hap", "gene").agg(F.max_by("call", "line_no").alias("call"))


def assembly_table(calls: DataFrame) -> DataFrame:
    """person_id, gene, asm_1, asm_2 with NA where a haplotype has no call."""
    wide = calls.groupBy("person_id", "gene").agg(*[
        F.max(F.when(F.col("hap") == f"hap{h}", F.col("call"))).alias(f"asm_{h}") for h in (1, 2)])
    return wide.fillna("NA", ["asm_1", "asm_2"])


def completed_people(lines: DataFrame) -> DataFrame:
    """People whose two haplotype files both hold at least one real call line."""
    lines = with_once(lines, {"text": F.get(F.split("value", "\t"), F.lit(8))})
    called = F.coalesce(_quoted("text", "consensus"), _quoted("text", "allele")).isNotNull()
    real = ~F.startswith("value", F.lit("#")) & called
    per_file = lines.groupBy("person_id", "hap").agg(F.count_if(real).alias("n"))
    return per_file.groupBy("person_id").agg(
        F.count_if((F.col("hap") == "hap1") & (F.col("n") > 0)).alias("_1"),
        F.count_if((F.col("hap") == "hap2") & (F.col("n") > 0)).alias("_2"),
    ).where("_1 > 0 and _2 > 0").select("person_id")
