"""Verdict on measured uplift per geography."""

from __future__ import annotations

from pyspark.sql import DataFrame


def uplift_summary(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``(geo, lift, significant, recommendation, message)``.

    Input: ``geo, treatment, control, lift, ci_low, ci_high, p_value``.  A lift
    is significant when its p-value is below ``alpha`` and its interval leaves
    out zero.  A missing ``lift`` is taken from treatment over control.
    """
    pct = "CAST(round({} * 100, 0) AS BIGINT)"
    lift = pct.format("lift")
    interval = f"concat(CAST({pct.format('ci_low')} AS STRING), '%–', CAST({pct.format('ci_high')} AS STRING), '%')"
    sure = (
        f"concat(geo, ' uplift ', IF({lift} >= 0, '+', ''), CAST({lift} AS STRING), "
        f"'% (95% CI: ', {interval}, '), statistically significant')"
    )
    unsure = "concat(geo, ' uplift not significant', IF(ci_low <= 0 AND ci_high >= 0, ', CI includes 0', ''))"
    return (
        df.selectExpr(
            "geo",
            "coalesce(lift, try_divide(treatment, control) - 1) AS lift",
            "ci_low",
            "ci_high",
            f"coalesce(p_value < {alpha}D AND NOT (ci_low <= 0 AND ci_high >= 0), false) AS significant",
        )
        .selectExpr(
            "geo",
            "lift",
            "significant",
            "IF(significant AND lift > 0, 'increase', 'reassess') AS recommendation",
            f"IF(significant, {sure}, {unsure}) AS message",
        )
    )
