"""The series that make up the composite, as a small dimension table."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Series:
    ord: int
    series_id: str
    family: str
    role: str
    source: str
    frequency: str
    staleness_days: int
    tier: str | None
    transform: str
    license: str
    shift_days: int


# Identifiers, families, limits and licences that results depend on.
# fmt: off
REGISTRY = (
    Series(1, "RSFSDP", "census_retail", "leading", "alfred", "monthly", 40, "A", "pooled_yoy_growth", "public", 0),
    Series(2, "RSFHFS", "census_retail", "leading", "alfred", "monthly", 40, "A", "pooled_yoy_growth", "public", 0),
    Series(3, "VISASMIDSA", "visa_smi", "leading", "alfred", "monthly", 40, "B", "hundred_minus_level", "visa_citation", 0),
    Series(4, "DPSACBW027SBOG", "household_liquidity", "leading", "alfred", "weekly", 21, "A", "pooled_yoy_growth", "public", 0),
    Series(5, "WRMFNS", "household_liquidity", "leading", "alfred", "weekly", 45, "A", "pooled_yoy_growth", "public", 2),
    Series(6, "UMICH_SCA_T2N_TOP", "umich_top_tercile", "leading", "archive", "monthly", 40, "A", "inverted_level", "umich_internal", 0),
    Series(7, "REVOLSL", "strain", "overlay", "alfred", "monthly", 40, None, "yoy_growth", "public", 0),
    Series(8, "DRCCLACBS", "strain", "overlay", "alfred", "quarterly", 110, None, "level", "public", 0),
    Series(9, "DRCARX1Q020SBEA", "outcome", "outcome", "alfred", "quarterly", 0, None, "quarterly_log_trend_gap_component", "public", 0),
    Series(10, "DFSARX1Q020SBEA", "outcome", "outcome", "alfred", "quarterly", 0, None, "quarterly_log_trend_gap_component", "public", 0),
)
# fmt: on
#: Families in the order of every report: four leading ones, then the overlay.
FAMILIES = ("census_retail", "visa_smi", "household_liquidity", "umich_top_tercile", "strain")
LEADING = FAMILIES[:4]


def by_id(series_id: str) -> Series:
    """The series of that id; KeyError if there is none."""
    return {s.series_id: s for s in REGISTRY}[series_id]


def registry(spark: SparkSession, engine_only: bool = False) -> DataFrame:
    """The table as a DataFrame of ten rows (eight with ``engine_only``), fit to be broadcast."""
    rows = [astuple(s) for s in REGISTRY if s.role != "outcome" or not engine_only]
    kinds = ", ".join(f"{f.name} {'int' if f.name in ('ord', 'staleness_days', 'shift_days') else 'string'}" for f in fields(Series))
    return spark.createDataFrame(rows, kinds)
