"""Row-level scores and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featlake.functions.ids import as_column

# Fixed default values of the losses.
FOCAL_ALPHA = 0.1
FOCAL_GAMMA = 2.0
COMBINED_FOCAL_ALPHA = 0.25
COMBINED_WEIGHTS = (0.3, 0.5, 0.2)
SMALL = 1e-8


def sigmoid(logit: Column | str) -> Column:
    """Probability of a logit; the exponent is never positive, so it cannot overflow."""
    x = as_column(logit)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def bce(logit: Column | str, label: Column | str) -> Column:
    """Binary cross entropy on a logit, finite for any finite logit."""
    x, y = as_column(logit), as_column(label)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def smoothed(label: Column | str, smoothing: float) -> Column:
    return as_column(label) * (1.0 - smoothing) + smoothing / 2.0


def focal(logit: Column | str, label: Column | str, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    """Focal loss: cross entropy, weighted down where the prediction is already right."""
    y = as_column(label)
    p = sigmoid(logit)
    p_true = p * y + (1.0 - p) * (1.0 - y)
    alpha_true = alpha * y + (1.0 - alpha) * (1.0 - y)
    return alpha_true * F.pow(1.0 - p_true, F.lit(gamma)) * bce(logit, y)


def not_nan(c: Column | str) -> Column:
    c = as_column(c)
    return c.isNotNull() & ~F.isnan(c)
