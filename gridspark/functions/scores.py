"""Aggregate expressions for regression scores. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinball(y: Column, p: Column, q: float) -> Column:
    diff = y - p
    return F.when(diff >= 0, diff * q).otherwise(diff * (q - 1))


def core_scores(y: Column, p: Column) -> dict[str, Column]:
    """RMSE, range-NRMSE, MAE, R2 = 1 - SSE/SST, bias and count."""
    sse = F.sum((p - y) * (p - y))
    sst = F.var_pop(y) * F.count(y)
    rmse = F.sqrt(F.avg((p - y) * (p - y)))
    spread = F.max(y) - F.min(y)
    return {
        "n_samples": F.count(y),
        "rmse": rmse,
        "nrmse_range": rmse / F.when(spread == 0, 1.0).otherwise(spread),
        "mae": F.avg(F.abs(p - y)),
        "r2": F.when(sst > 0, 1 - sse / sst),
        "bias": F.avg(p - y),
    }


def agreement_scores(y: Column, p: Column) -> dict[str, Column]:
    """Kling-Gupta efficiency with its parts, percent bias, mean-NRMSE and ratio of totals."""
    enough = F.count(y) >= 3
    sse = F.sum((p - y) * (p - y))
    sst = F.var_pop(y) * F.count(y)
    rmse = F.sqrt(F.avg((p - y) * (p - y)))
    varied = enough & (F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0)
    usable = varied & (F.avg(y) > 0)
    r = F.when(varied, F.corr(y, p))
    alpha = F.when(usable, F.stddev_pop(p) / F.stddev_pop(y))
    beta = F.when(usable, F.avg(p) / F.avg(y))
    kge = F.when(usable, 1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1)))
    return {
        "n": F.count(y),
        "r2": F.when(enough & (sst > 0), 1 - sse / sst),
        "rmse": F.when(enough, rmse),
        "mae": F.when(enough, F.avg(F.abs(p - y))),
        "nrmse_mean": F.when(enough & (F.avg(y) > 0), rmse / F.avg(y)),
        "bias": F.when(enough, F.avg(p - y)),
        "corr": r,
        "kge": kge,
        "kge_alpha": alpha,
        "kge_beta": beta,
        "pbias": F.when(enough & (F.sum(y) > 0), F.sum(p - y) / F.sum(y) * 100),
        "total_ratio": F.when(enough & (F.sum(y) > 0), F.sum(p) / F.sum(y)),
    }


def interval_scores(y: Column, lo: Column, hi: Column) -> dict[str, Column]:
    inside = (y >= lo) & (y <= hi)
    return {
        "picp_80": F.avg(inside.cast("double")),
        "piw_80": F.avg(hi - lo),
        "below_q10": F.avg((y < lo).cast("double")),
        "above_q90": F.avg((y > hi).cast("double")),
    }


def improvement_pct(base: Column, new: Column) -> Column:
    return F.when(base > 0, (base - new) / base * 100).otherwise(0.0)


def crps(y: Column, predictions: dict[float, Column]) -> Column:
    """Mean pinball loss over a set of quantile predictions."""
    losses = [F.avg(pinball(y, p, q)) for q, p in sorted(predictions.items())]
    total = losses[0]
    for loss in losses[1:]:
        total = total + loss
    return total / len(losses)
