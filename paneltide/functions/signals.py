"""Arithmetic of the indicators: sentiment skew, spreads, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Source series of the macro predictors.
GOV_3M = "中债国债到期收益率:3月"
GOV_6M = "中债国债到期收益率:6月"
GOV_10Y = "中债国债到期收益率:10年"
CORP_AAA_10Y = "中债企业债到期收益率(AAA):10年"
INTERBANK_3M = "银行间同业拆借加权利率:3个月"
VOLATILITY = "Volatility"
LOG_RETURN = "Log_Return"


def scaled(value: Column, factor: float = -100.0) -> Column:
    """Risk proxy: the sign flip makes larger mean riskier."""
    return F.lit(float(factor)) * value


def skew(negative: Column, positive: Column) -> Column:
    """Smoothed log ratio, above zero when the mood is gloomy."""
    return F.log((negative + 1) / (positive + 1))


def sentiment_features(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "Total_Count": c("Positive_Count") + c("Neutral_Count") + c("Negative_Count"),
        "Emotional_Skew": skew(c("Negative_Count"), c("Positive_Count")),
        "Weighted_Emotional_Skew_Read": skew(c("Negative_read_num"), c("Positive_read_num")),
        "Weighted_Emotional_Skew_Comment": skew(c("Negative_comments_num"), c("Positive_comments_num")),
    })


def macro_spreads(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Liquidity, term and credit spread, realised volatility and market return.

    ``names`` maps the standard source names above to the columns of the frame where they differ.
    """
    names = names or {}

    def c(name):
        return F.col(f"`{names.get(name, name)}`")

    return df.withColumns({
        "LS": c(INTERBANK_3M) - c(GOV_3M),
        "YS": c(GOV_10Y) - c(GOV_6M),
        "CS": c(CORP_AAA_10Y) - c(GOV_10Y),
        "VIX": c(VOLATILITY),
        "Market_Return": c(LOG_RETURN),
    })
