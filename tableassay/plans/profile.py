"""Profiles and reports of one table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableassay.functions.schema import (
    categorical_columns,
    datetime_columns,
    numeric_columns,
    text,
    union_all,
)
from tableassay.operators import calendar, distributions, relations, rules, stats
from tableassay.operators.quantiles import QUARTERS, Ranges, brackets, settled
from tableassay.sources.auto import load_auto

REPORT = "section string, column string, metric string, value double"


class Profile:
    """One table and its analyses; every method returns a DataFrame.

    ``exact=False`` takes quartiles and distinct counts from sketches.
    """

    def __init__(
        self,
        df: DataFrame | None,
        exact: bool = True,
    ):
        if df is None:
            raise ValueError("no data: load a table first")
        self.data = df
        self.exact = exact
        self.numeric_columns = numeric_columns(df)
        self.categorical_columns = categorical_columns(df)
        self.datetime_columns = datetime_columns(df)
        self._ranges: Ranges | None = None

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        path: str,
        table_name: str | None = None,
        query: str | None = None,
        exact: bool = True,
        **options,
    ) -> Profile:
        """Read a file by its suffix and profile it; ``options`` go to the reader."""
        return cls(load_auto(spark, path, table_name, query, **options), exact)

    @property
    def ranges(self) -> Ranges | None:
        """Quartiles and their brackets, found once and shared by all exact quartile users."""
        if self.exact and self._ranges is None and self.numeric_columns:
            self._ranges = settled(self.data, QUARTERS, brackets(self.data, self.numeric_columns, QUARTERS))
        return self._ranges

    def column_types(self) -> DataFrame:
        return stats.column_types(self.data)

    def shape(self) -> DataFrame:
        return stats.shape(self.data)

    def basic_info(self) -> DataFrame:
        return stats.basic_info(self.data, self.exact)

    def statistical_summary(self) -> DataFrame:
        return stats.statistical_summary(self.data, exact=self.exact, ranges=self.ranges)

    def missing_values(self) -> dict[str, DataFrame]:
        return {
            "missing_nonzero": stats.missing_nonzero(self.data),
            "null_pattern": distributions.null_pattern(self.data),
        }

    def numeric_distributions(self, kde_bins: int | None = None) -> dict[str, DataFrame]:
        return {
            "histogram_density": distributions.histogram_density(self.data),
            "kde": distributions.kde(self.data, bins=kde_bins),
        }

    def categorical_distributions(self, top_n: int = 10) -> DataFrame:
        return distributions.value_counts_topn(self.data, top_n=top_n)

    def correlation_analysis(self) -> dict[str, DataFrame]:
        return {
            "correlation_matrix": relations.correlation_matrix(self.data),
            "high_correlations": relations.high_correlations(self.data),
        }

    def outlier_detection(self) -> DataFrame:
        return relations.outlier_detection(self.data, exact=self.exact, ranges=self.ranges)

    def box_stats(self) -> DataFrame:
        return distributions.box_stats(self.data, exact=self.exact, ranges=self.ranges)

    def feature_insights(self) -> DataFrame:
        return rules.feature_insights(self.data)

    def quality_issues(self) -> DataFrame:
        return rules.quality_issues(self.data)

    def time_series_analysis(self) -> dict[str, DataFrame]:
        return {
            "date_range": calendar.date_range(self.data),
            "daily_counts": calendar.daily_counts(self.data),
            "monthly_pattern": calendar.monthly_pattern(self.data),
            "weekday_pattern": calendar.weekday_pattern(self.data),
            "hourly_pattern": calendar.hourly_pattern(self.data),
        }

    def target_analysis(self, target: str) -> dict[str, DataFrame]:
        return target_analysis(self.data, target, self.exact, self.ranges)

    def complete_analysis(self, target: str | None = None, persist: bool = False) -> dict[str, DataFrame]:
        return complete_analysis(self, target, persist)

    def profile_report(self) -> DataFrame:
        return profile_report(self.data, self.exact, self.ranges)

    def target_report(self, target: str | None = None) -> DataFrame:
        return target_report(self.data, target, self.exact, self.ranges)


def target_analysis(
    df: DataFrame, target: str, exact: bool = True, ranges: Ranges | None = None
) -> dict[str, DataFrame]:
    """Distribution of the target, its plots' tables and the closest features."""
    out = {"target_distribution": relations.target_distribution(df, target, exact, ranges)}
    if relations.is_numeric_target(df, target):
        out["target_histogram"] = distributions.histogram_count(df, target)
        out["target_box"] = distributions.box_stats(df, [target], exact, ranges)
        out["target_correlation"] = relations.target_correlation(df, target)
        out["scatter_grid"] = relations.scatter_grid(df, target)
    else:
        out["target_proportions"] = distributions.proportions(df, target)
    return out


def complete_analysis(
    profile: Profile, target: str | None = None, persist: bool = False, kde_bins: int | None = None
) -> dict[str, DataFrame]:
    """The ten steps in order, as lazy tables by name.

    Most steps read few columns of a column store, so by default each scans
    what it needs.  ``persist`` keeps the input for sources that are slow to
    read; the caller unpersists ``profile.data``.  ``kde_bins`` trades exact
    densities for counts per bin.
    """
    if persist:
        profile.data = profile.data.persist(StorageLevel.DISK_ONLY)
    out = {
        "basic_info": profile.basic_info(),
        "statistical_summary": profile.statistical_summary(),
        **profile.missing_values(),
        **profile.numeric_distributions(kde_bins),
        "value_counts_topn": profile.categorical_distributions(),
        **profile.correlation_analysis(),
        "outlier_detection": profile.outlier_detection(),
        "box_stats": profile.box_stats(),
        "feature_insights": profile.feature_insights(),
        "quality_issues": profile.quality_issues(),
        **profile.time_series_analysis(),
    }
    if target is not None and target in profile.data.columns:
        out.update(profile.target_analysis(target))
    return out


def _metrics(df: DataFrame, section: str, key: str, metrics: list[str]) -> DataFrame:
    cells = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    return df.selectExpr(f"'{section}' AS section", key, f"stack({len(metrics)}, {cells}) AS (metric, value)")


def profile_report(df: DataFrame, exact: bool = True, ranges: Ranges | None = None) -> DataFrame:
    """``(section, column, metric, value)``: overview, variables, statistics,
    distributions, correlations, missing cells, duplicates."""
    whole = "CAST(NULL AS STRING) AS column"
    overview = (
        stats.shape(df)
        .withColumn("numeric", F.lit(len(numeric_columns(df))))
        .withColumn("categorical", F.lit(len(categorical_columns(df))))
        .withColumn("datetime", F.lit(len(datetime_columns(df))))
    )
    parts = [
        _metrics(overview, "overview", whole, ["rows", "columns", "numeric", "categorical", "datetime"]),
        _metrics(rules.duplicate_rows(df), "overview", whole, ["duplicates", "duplicate_pct"]),
        _metrics(stats.missing_summary(df), "missing", "column", ["missing", "missing_pct"]),
        _metrics(stats.distinct_counts(df, exact=exact), "variables", "column", ["distinct"]),
        stats.statistical_summary(df, exact=exact, ranges=ranges).selectExpr(
            "'statistics' AS section", "column", "stat AS metric", "value"
        ),
        distributions.histogram_density(df).selectExpr(
            "'histogram' AS section", "column", "CAST(bin AS STRING) AS metric", "CAST(count AS DOUBLE) AS value"
        ),
        distributions.value_counts_topn(df).selectExpr(
            "'frequent' AS section", "column", "value AS metric", "CAST(count AS DOUBLE) AS value"
        ),
        relations.correlation_lower_triangle(df).selectExpr(
            "'correlation' AS section", "feature_1 AS column", "feature_2 AS metric", "r AS value"
        ),
    ]
    return union_all(parts)


def target_report(
    df: DataFrame, target: str | None = None, exact: bool = True, ranges: Ranges | None = None
) -> DataFrame:
    """``profile_report`` plus the target's relations; the plain report if it is absent."""
    report = profile_report(df, exact, ranges)
    if target is None or target not in df.columns:
        return report
    if relations.is_numeric_target(df, target):
        extra = relations.target_relation_rows(df, target)
    else:
        extra = distributions.proportions(df, target).selectExpr(
            "'target' AS section", f"{text(target)} AS column", "CAST(value AS STRING) AS metric", "pct AS value"
        )
    return report.unionByName(extra)


