"""Return and forecast metrics per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Series
from .signals import profit_factor, sharpe


def equity(s: Series, ret: str = "ret") -> Series:
    """Running product of (1 + return), its running peak and the drawdown as a share of the peak.

    The product is kept as sum of logarithms, number of negative factors and number of zero factors.
    """
    f = 1 + F.col(ret)
    s = s.scan(
        {
            "_lg": ("sum", F.when(f != 0, F.ln(F.abs(f)))),
            "_neg": ("count", F.when(f < 0, 1)),
            "_zero": ("count", F.when(f == 0, 1)),
        }
    )
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    value = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(sign * F.exp(F.coalesce("_lg", F.lit(0.0))))
    s = s.with_columns({"equity": F.when(F.col(ret).isNotNull(), value)})
    s = s.scan({"peak": ("max", F.col("equity"))})
    base = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    s = s.with_columns({"drawdown": (F.col("peak") - F.col("equity")) / base})
    return Series(s.df.drop("_lg", "_neg", "_zero"), s.keys, s.order, s.bucket)


def return_metrics(ret: str = "ret", periods: int = 252) -> list[Column]:
    """Aggregates over a frame from :func:`equity`."""
    r = F.col(ret)
    return [
        F.count(r).alias("n_returns"),
        sharpe(F.avg(r), F.stddev_pop(r), F.count(r), periods).alias("sharpe"),
        profit_factor(r).alias("profit_factor"),
        F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"),
    ]


def forecast_steps(s: Series, actual: str, predicted: str) -> Series:
    """Changes of actual and predicted value against the previous row."""
    rl = s.rolling(1)
    rl.add({"_d_true": F.col(actual) - rl.lag(actual), "_d_pred": F.col(predicted) - rl.lag(predicted),
            "_p_true": rl.lag(actual), "_p_pred": rl.lag(predicted)})
    same = F.signum("_d_true") == F.signum("_d_pred")
    rl.add({
        "same_direction": F.when(F.col("_d_true").isNotNull(), same.cast("double")),
        "ret": F.signum(F.try_divide(F.col("_d_pred"), F.col("_p_pred"))) * F.try_divide(F.col("_d_true"), F.col("_p_true")),
    })
    rl.df = rl.df.drop("_d_true", "_d_pred", "_p_true", "_p_pred")
    return rl.series()


def forecast_errors(actual: str, predicted: str, pip: float) -> list[Column]:
    e = (F.col(actual) - F.col(predicted)) / pip
    return [
        F.sqrt(F.avg(e * e)).alias("rmse_pips"),
        F.avg(F.abs(e)).alias("mae_pips"),
        F.coalesce(F.avg("same_direction"), F.lit(0.0)).alias("directional_accuracy"),
    ]
