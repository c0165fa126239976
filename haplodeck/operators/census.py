"""What files exist for whom: column classes, profiles and trim tiers over a wide manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplodeck import domain
from haplodeck.functions.text import pct
from haplodeck.functions.uris import file_kind
from haplodeck.operators.rows import first_per_key


def column_report(manifest: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per text column: filled cells, the first one's value by row id, and the column's class by all
    filled cells. One pass, one partial aggregate with a few numbers per column."""
    texts = [c for c, t in manifest.dtypes if t == "string"]
    measures = []
    for i, c in enumerate(texts):
        value = F.when(F.col(c) != "", F.col(c))
        kind = file_kind(value)
        measures += [
            F.count(value).alias(f"n{i}"), F.count_if(kind == "primary").alias(f"p{i}"),
            F.count_if(kind == "index").alias(f"x{i}"),
            F.min(F.when(value.isNotNull(), F.struct(F.col(row_id), value.alias("v")))).alias(f"s{i}"),
        ]
    columns = manifest.agg(*measures).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_filled"),
                 F.col(f"s{i}.v").alias("sample_value"), F.col(f"p{i}").alias("_p"),
                 F.col(f"x{i}").alias("_x")) for i, c in enumerate(texts)])).alias("_e")).select("_e.*")
    half = F.greatest(F.lit(1), F.floor(F.col("n_filled") / 2))
    return columns.select(
        "column", "n_filled", "sample_value",
        F.when(F.col("_p") >= half, "primary").when(F.col("_x") >= half, "index").alias("kind"))


def _profile_text(present):
    names = F.array_sort(present)
    return F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise(domain.NO_PROFILE)


def _present(existing: DataFrame, key: str, columns: list[str] | None) -> DataFrame:
    """key, present: the sources of every key. Of at most 62 known names one number per key is grouped, a bit
    per name, instead of a set."""
    if columns is None or len(columns) > 62:
        return existing.groupBy(key).agg(F.collect_set("source").alias("present"))
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(1 << i).cast("long"))]),
                       F.col("source"))
    bits = existing.groupBy(key).agg(F.bit_or(bit).alias("_bits"))
    return bits.select(key, F.array_compact(F.array(*[
        F.when(F.getbit("_bits", F.lit(i)) == 1, c) for i, c in enumerate(columns)])).alias("present"))


def row_profiles(manifest: DataFrame, existing: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every manifest row with the sorted list of its existing columns and the profile text. `columns`: all
    names that `source` may have, if they are known."""
    present = _present(existing, "row_id", columns)
    empty = F.array().cast("array<string>")
    return manifest.join(present, "row_id", "left").withColumn(
        "present", F.array_sort(F.coalesce("present", empty))
    ).withColumn("profile", _profile_text(F.col("present")))


def union_profiles(manifest: DataFrame, existing: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per person the union of existing columns over all rows. The set holds column names, so it
    stays small for a person with any number of rows."""
    present = _present(existing, "person_id", columns).withColumnRenamed("present", "_p")
    people = manifest.groupBy("person_id").agg(F.count("*").alias("n_rows"))
    empty = F.array().cast("array<string>")
    return people.join(present, "person_id", "left").select(
        "person_id", "n_rows", _profile_text(F.coalesce("_p", empty)).alias("profile"))


def profile_distribution(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows per profile, optionally per platform or center, with the share of all rows."""
    counts = rows.groupBy(*keys, "profile").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per profile seen
    return counts.select(*keys, "profile", "n", pct(F.col("n"), total).alias("n_pct"))


def top_profiles(distribution: DataFrame, keys: list[str] = (), k: int = 40) -> DataFrame:
    return distribution.orderBy(F.col("n").desc(), *keys, "profile").limit(k)


def multi_row_people(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("person_id").agg(F.count("*").alias("n_rows")).where(
        F.col("n_rows") > 1)


def first_label(manifest: DataFrame, column: str = "platform") -> DataFrame:
    """One platform or center label per person: that of the lowest row id."""
    return first_per_key(manifest, ["person_id"], [F.col("row_id")]).select("person_id", column)


def none_found_by(union: DataFrame, labels: DataFrame, column: str = "platform") -> DataFrame:
    """People without any existing file, by label."""
    return union.where(F.col("profile") == domain.NO_PROFILE).join(
        labels, "person_id", "left").groupBy(column).agg(F.count("*").alias("n"))


def row_tier(fa: list[str], paf: list[str], aln: list[str]):
    """Trim tier a row alone supports, from its `present` list; null without both sequences."""
    def has(cols):
        return F.size(F.array_except(F.array(*[F.lit(c) for c in cols]), F.col("present"))) == 0

    return F.when(has(fa), F.when(has(paf), domain.TIERS[0]).when(has(aln), domain.TIERS[1])
                  .otherwise(domain.TIERS[2]))


def best_tiers(rows: DataFrame) -> DataFrame:
    """Per person the best tier of any row, the platform of the first row and the row count."""
    rank = F.array_position(F.array(*[F.lit(t) for t in domain.TIERS]), F.col("trim_tier"))
    out = rows.groupBy("person_id").agg(
        F.min_by("platform", "row_id").alias("platform"), F.min(rank).alias("_r"),
        F.count("*").alias("n_rows"),
    )
    tiers = F.array(*[F.lit(t) for t in domain.TIERS])
    return out.withColumn("trim_tier", F.try_element_at(tiers, F.col("_r").cast("int"))).drop("_r")


def eligible_head(people: DataFrame, n: int) -> DataFrame:
    """Smoke cap: the first n eligible people by id."""
    return people.where(F.col("trim_tier").isNotNull()).orderBy("person_id").limit(n)


def load_worklist(cohort: DataFrame) -> DataFrame:
    """Worklist columns with ancestry NA where the column or the value is absent."""
    for needed in ("person_id", "trim_tier"):
        if needed not in cohort.columns:
            raise ValueError(f"cohort has no column {needed}: {cohort.columns}")
    label = F.coalesce("ancestry", F.lit("NA")) if "ancestry" in cohort.columns else F.lit("NA")
    return cohort.select("person_id", "trim_tier", label.alias("ancestry"))
