"""Keyed row choice and keyed table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_once(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    A later filter or projection on a computed column would otherwise be merged into the scan with
    the whole expression copied for every use. Taking the new values through a one-element explode
    stops that copying and keeps the generated methods small enough to be compiled; the old columns
    pass by, so pruning and an existing partitioning are kept."""
    kept = [c for c in df.columns if c not in new]
    return df.withColumns(new).select(
        *kept, F.explode(F.array(F.struct(*new))).alias("_row")
    ).select(*kept, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1,
                  rank_name: str | None = None) -> DataFrame:
    """First n rows per key. The rank filter is pushed below the shuffle (window group limit), so
    each task sends at most n rows of a key, however often the key occurs."""
    name = rank_name or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank_name else kept.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], newest: str, tiebreak: list[str] = ()) -> DataFrame:
    order = [F.col(newest).desc(), *[F.col(t).desc() for t in tiebreak]]
    return first_per_key(df, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of keys that do not come again, plus all new rows."""
    touched = new.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def compact_fragments(canonical: DataFrame, fragments: DataFrame, keys: list[str],
                      version: str) -> DataFrame:
    """Canonical table and fragments as one table with the last version of every key."""
    rows = canonical.unionByName(fragments, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in keys and c != version]
    return latest_per_key(rows, keys, version, others)


def resume_worklist(people: DataFrame, done: DataFrame, given_up: DataFrame,
                    key: str = "person_id") -> DataFrame:
    """People that are neither done nor given up."""
    return people.join(done.select(key).distinct(), key, "left_anti").join(
        given_up.select(key).distinct(), key, "left_anti"
    )


def missing_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of several id sets with one has_<name> flag each."""
    tagged = None
    for name, ids in sets.items():
        part = ids.select(key).where(F.col(key).isNotNull()).withColumn("_set", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(
        *[F.bool_or(F.col("_set") == name).alias(f"has_{name}") for name in sets]
    )


def set_difference(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Ids on one side only, both ways, labelled with the side."""
    ids_a = a.select(key).where(F.col(key).isNotNull()).distinct()
    ids_b = b.select(key).where(F.col(key).isNotNull()).distinct()
    return (
        ids_a.join(ids_b, key, "left_anti").withColumn("only_in", F.lit(a_name))
        .unionByName(ids_b.join(ids_a, key, "left_anti").withColumn("only_in", F.lit(b_name)))
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones for the same seed on any partitioning. Each task
    keeps its own n smallest hashes before anything is merged."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(mixed, F.col(key)).limit(n)


def phase_split(df: DataFrame, tier: str = "trim_tier", skip: list[str] = (),
                only: list[str] = ()) -> DataFrame:
    """Rows outside the skipped tiers and, if given, inside the wanted ones. Null tiers are never
    skipped and never wanted."""
    out = df
    if skip:
        out = out.where(F.col(tier).isNull() | ~F.col(tier).isin(list(skip)))
    if only:
        out = out.where(F.col(tier).isin(list(only)))
    return out
