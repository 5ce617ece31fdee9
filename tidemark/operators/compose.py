"""Families, tiers and the headline: all-or-nothing aggregation with explicit abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import six_places
from tidemark.registry import LEADING

ABSTAIN_AT = 2
ASSUMPTION = "validation_assumption:umich_unrevised_final"


def gate(members: DataFrame, keys: list[str], ord_col: str = "ord", more: dict[str, Column] | None = None) -> DataFrame:
    """Flags of each family, in member order: any missing, invalid or stale member makes the whole family abstain.

    ``members`` has a row for each expected member with series_id, is_missing, is_invalid and is_stale; ``more`` are
    aggregates of the members by name, that come from the same pass.
    """
    flag = (
        F.when(F.col("is_missing"), F.concat(F.lit("missing_member:"), "series_id"))
        .when(F.col("is_invalid"), F.concat(F.lit("invalid_member:"), "series_id"))
        .when(F.col("is_stale"), F.concat(F.lit("stale_member:"), "series_id"))
    )
    grouped = members.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(flag.isNotNull(), F.struct(ord_col, flag.alias("flag"))))).alias("found"),
        F.count(F.lit(1)).alias("n_members"),
        *[column.alias(name) for name, column in (more or {}).items()],
    )
    return grouped.withColumn("flags", F.transform("found", lambda x: x["flag"])).withColumn(
        "abstained", F.size("found") > 0
    ).drop("found")


def all_or_nothing_mean(rows: DataFrame, keys: list[str], value: str, n_members: int) -> DataFrame:
    """The mean of a family's member scores, only if every member has one."""
    grouped = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("scored"))
    return grouped.withColumn("mean", F.when(F.col("scored") == n_members, F.col("mean")))


def tiers(families: DataFrame, keys: list[str]) -> DataFrame:
    """Tier A, tier B, headline, abstention and flags of each assembly, from family, tier and z (null: abstained).

    Tier A is the mean over its available families, tier B over all leading families if its own is there; the composite
    abstains if two or more of the four leading families do. Flags name the families that abstain; an ``assumed`` column
    says whether a family's availability rests on an assumption, which the first flag names.
    """
    leading = families.where(F.col("family").isin(*LEADING))
    expected = F.array(*[F.lit(f) for f in LEADING])
    grouped = leading.groupBy(*keys).agg(
        F.avg(F.when(F.col("tier") == "A", F.col("z"))).alias("mean_a"),
        F.avg("z").alias("mean_all"),
        F.max(F.when(F.col("tier") == "B", F.col("z").isNotNull())).alias("has_b"),
        F.collect_set(F.when(F.col("z").isNotNull(), F.col("family"))).alias("scored"),
        F.coalesce(F.max(F.col("assumed") if "assumed" in families.columns else F.lit(False)), F.lit(False)).alias("assumed"),
    )
    absent = F.filter(expected, lambda f: ~F.array_contains(F.col("scored"), f))
    grouped = grouped.withColumn("absent", absent)
    n_absent = F.size("absent")
    abstained = n_absent >= ABSTAIN_AT
    tier_a = F.when(~abstained, F.col("mean_a"))
    tier_b = F.when(~abstained & F.coalesce("has_b", F.lit(False)), F.col("mean_all"))
    summary: Column = F.when(
        abstained, F.array(F.format_string("leading_abstained:%d_of_%d_families", n_absent, F.lit(len(LEADING))))
    ).when(n_absent > 0, F.array(F.concat(F.lit("leading_renormalized:"), F.array_join("absent", ","))))
    flags = F.concat(
        F.when(F.col("assumed"), F.array(F.lit(ASSUMPTION))).otherwise(F.array().cast("array<string>")),
        F.transform("absent", lambda f: F.concat(F.lit("family_abstention:"), f)),
        F.coalesce(summary, F.array().cast("array<string>")),
    )
    return grouped.select(
        *keys,
        six_places(tier_a).alias("tier_a"),
        six_places(tier_b).alias("tier_b"),
        six_places(F.coalesce(tier_b, tier_a)).alias("headline"),
        F.when(~abstained, F.when(tier_b.isNotNull(), "B").when(tier_a.isNotNull(), "A")).alias("headline_tier"),
        abstained.alias("abstained"),
        flags.alias("flags"),
    )


def redact(rows: DataFrame, licenses: str = "licenses", value: str = "transformed_value", internal: str = "umich_internal") -> DataFrame:
    """Hide the transformed value of every row that an internal licence covers."""
    hidden = F.array_contains(licenses, internal)
    return rows.withColumn("redacted", hidden).withColumn(value, F.when(~hidden, F.col(value)))
