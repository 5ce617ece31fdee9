"""Archived releases as CSV: every rule as data, spans and coverage as plans."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import safe_path, strict_date, utc_timestamp
from tidemark.operators import pit
from tidemark.registry import registry
from tidemark.schemas import ARCHIVE_COLUMNS

STAGES = ("preliminary", "final", "revision", "not_applicable")
CANONICAL, PROVISIONAL = ("final",), ("preliminary", "final")
#: The order of an archive file.
ORDER = ("series_id", "observation_date", "effective_date", "release_stage", "retrieved_at", "release_date", "source_file")


@dataclass(frozen=True)
class Archive:
    """Valid rows, and issues as (file, line, severity, code)."""

    rows: DataFrame
    issues: DataFrame

    def ordered(self) -> DataFrame:
        """The valid rows in the order of an archive file."""
        return self.rows.orderBy(*ORDER)

    def coverage(self) -> DataFrame:
        """The last retrieval of each series: what an archive can vouch for."""
        return self.rows.groupBy("series_id").agg(F.max("retrieval_date").alias("complete_through"))

    def spans(self, stages: tuple[str, ...] = CANONICAL, assume_unrevised: bool = False) -> DataFrame:
        """Spans of these stages only: built after the choice, so that an unseen stage closes nothing."""
        effective = "release_date" if assume_unrevised else "effective_date"
        kept = self.rows.where(F.col("release_stage").isin(*stages))
        return pit.build_spans(kept, self.coverage(), effective, ORDER[3:])


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, values): the records of CSV files, with the line each begins at, as many values as it has.

    Spark reads the files, so that any file system will do; a quoted value may hold line feeds. Files are dealt to tasks
    one by one: an archive has some hundred rows. Blank lines are no records.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["value"]):
                body = io.StringIO(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), newline="")
                reader, before = csv.reader(body), 0
                for values in reader:
                    if values:
                        out.append((file, before + 1, values))
                    before = reader.line_num
            yield pd.DataFrame(out, columns=["file", "line", "values"])

    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.mapInPandas(parse, "file string, line int, values array<string>")


def rule_codes(rows: DataFrame) -> DataFrame:
    """Add parsed dates (obs, rel, got) and ``codes``: the rules that each row of text columns breaks, in a fixed order.

    ``too_long`` says whether a row has more values than its header.
    """
    spark = rows.sparkSession
    series = F.broadcast(registry(spark).where("source = 'archive'").select(F.col("series_id").alias("known_id")))
    rows = rows.join(series, F.col("series_id") == F.col("known_id"), "left")
    rows = rows.withColumns(
        {
            "obs": strict_date(F.col("observation_date")),
            "rel": strict_date(F.col("release_date")),
            "got": utc_timestamp(F.col("retrieved_at")),
        }
    )
    # Each rule in turn; the codes of a row keep this order.
    umich = F.col("series_id").startswith("UMICH")
    rules = {
        "extra_value": F.col("too_long"),
        "missing_value": F.array_contains(F.array(*[F.coalesce(F.trim(c), F.lit("")) == "" for c in ARCHIVE_COLUMNS]), True),
        "unknown_series": F.col("known_id").isNull(),
        "unsafe_source_file": ~safe_path(F.col("source_file")),
        "unknown_stage": ~F.col("release_stage").isin(*STAGES),
        "stage_not_allowed": umich & F.col("release_stage").isin(*STAGES[2:]),
        "invalid_observation_date": F.col("obs").isNull(),
        "invalid_release_date": F.col("rel").isNull(),
        "invalid_retrieved_at": F.col("got").isNull(),
        "release_before_observation": F.col("rel") < F.col("obs"),
        "release_after_retrieval": F.col("rel") > F.to_date("got"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return rows.withColumn("codes", codes).drop("known_id")


def read_archive(spark: SparkSession, paths: str | list[str]) -> Archive:
    """Read release files with a header of the seven required columns, in any order; others are a warning.

    Rows that break a rule are left out and reported; so are headers, files without rows, rows out of order, repeated
    rows, and rows that contradict each other on one effective date.
    """
    found = records(spark, [paths] if isinstance(paths, str) else list(paths))
    first = found.groupBy("file").agg(F.min_by("values", "line").alias("names"), F.min("line").alias("head"))
    header = first.select("file", F.transform("names", lambda x: F.trim(x)).alias("names"), "head")
    missing = F.array_except(F.array(*[F.lit(c) for c in ARCHIVE_COLUMNS]), "names")
    extra = F.array_except("names", F.array(*[F.lit(c) for c in ARCHIVE_COLUMNS]))
    issue = lambda code, severity="error": F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    head_issues = header.select(
        "file", F.col("head").alias("line"),
        F.explode(F.array_compact(F.array(
            F.when(F.size(missing) > 0, issue("missing_columns")),
            F.when(F.size(F.array_distinct("names")) < F.size("names"), issue("duplicate_columns")),
            F.when(F.size(extra) > 0, issue("extra_columns", "warning")),
        ))).alias("i"),
    ).select("file", "line", "i.severity", "i.code")
    good = header.where((F.size(missing) == 0) & (F.size(F.array_distinct("names")) == F.size("names")))
    parsed = found.join(good, "file").where("line > head")
    value = lambda name: F.get("values", (F.array_position("names", name) - 1).cast("int"))
    rows = parsed.select(
        "file", "line", *[value(c).alias(c) for c in ARCHIVE_COLUMNS],
        (F.size("values") > F.size("names")).alias("too_long"),
    )
    rows = rule_codes(rows)
    row_issues = rows.select("file", "line", F.lit("error").alias("severity"), F.explode("codes").alias("code"))
    valid = rows.where(F.size("codes") == 0).select(
        "file", "line", "series_id", F.col("obs").alias("observation_date"), "value_text", F.col("rel").alias("release_date"),
        "release_stage", "source_file", "retrieved_at", F.to_date("got").alias("retrieval_date"),
        F.greatest("rel", F.to_date("got")).alias("effective_date"),
    )
    key = F.struct(*[F.col(c).cast("string") for c in ORDER])
    in_file = Window.partitionBy("file").orderBy("line")  # archives are files of a few hundred rows
    twins = Window.partitionBy("series_id", "observation_date", "effective_date")
    marked = valid.withColumns(
        {
            "unsorted": key < F.lag(key).over(in_file),
            "n_same": F.count(F.lit(1)).over(twins),
            "n_values": F.size(F.collect_set(F.struct("value_text", "release_stage", "release_date", "source_file")).over(twins)),
        }
    )
    more = marked.select(
        "file", "line",
        F.explode(F.array_compact(F.array(
            F.when(F.col("unsorted"), F.lit("not_in_order")),
            F.when((F.col("n_same") > 1) & (F.col("n_values") == 1), F.lit("duplicate_row")),
            F.when(F.col("n_values") > 1, F.lit("conflicting_rows")),
        ))).alias("code"),
    ).select("file", "line", F.lit("error").alias("severity"), "code")
    kinds = F.broadcast(registry(spark).select("series_id", "frequency"))  # ten rows
    late = pit.gaps(valid.select("series_id", "observation_date").distinct().join(kinds, "series_id"), F.col("frequency"))
    late = late.select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("warning").alias("severity"), F.lit("gap").alias("code"))
    empty = good.join(parsed.select("file").distinct(), "file", "left_anti")
    empty = empty.select("file", F.col("head").alias("line"), F.lit("error").alias("severity"), F.lit("no_rows").alias("code"))
    issues = head_issues.unionByName(row_issues).unionByName(more).unionByName(late).unionByName(empty)
    return Archive(valid, issues)
