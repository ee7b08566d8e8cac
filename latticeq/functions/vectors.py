"""Vector expressions: dot products, norms, pooling, and half-precision rounding.

Sums run in DOUBLE from the first element on, so that results do not depend on vectorisation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in DOUBLE; the cosine if both are normalised."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """The vector by its norm; a norm under 1e-12 counts as that."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def merge_views(v: Column, flipped: Column) -> Column:
    """Test-time merge of a vector and the one of the mirrored view: normalised sum."""
    return l2_normalize(add(v, flipped))


def generalized_mean(v: Column | str, p: float = 3.0, eps: float = 1e-6) -> Column:
    """Pooling between mean and maximum: ``mean(max(x, eps) ** p) ** (1 / p)``."""
    powers = F.transform(v, lambda x: F.pow(F.greatest(x.cast("double"), F.lit(eps)), F.lit(p)))
    return F.pow(F.aggregate(powers, F.lit(0.0), lambda s, x: s + x) / F.size(v), F.lit(1.0 / p))


def token_mean(v: Column | str, prefix: int = 0) -> Column:
    """Mean of the entries behind a prefix."""
    rest = F.slice(v, prefix + 1, F.greatest(F.size(v) - prefix, F.lit(0)))
    return F.aggregate(rest, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(rest)


def linear_head(v: Column | str, weights: list[list[float]], bias: list[float], mean: list[float] | None = None, var: list[float] | None = None, scale: list[float] | None = None, shift: list[float] | None = None, eps: float = 1e-5) -> Column:
    """A linear layer and, where ``mean`` is given, batch normalisation with stored statistics."""
    out = []
    for k, (w, b) in enumerate(zip(weights, bias)):
        y = dot(v, F.array(*(F.lit(float(x)) for x in w))) + float(b)
        if mean is not None:
            y = (y - mean[k]) / F.sqrt(F.lit(var[k] + eps)) * (scale[k] if scale else 1.0) + (shift[k] if shift else 0.0)
        out.append(y)
    return F.array(*out)


@F.pandas_udf(ArrayType(FloatType()))
def half_precision(v: pd.Series) -> pd.Series:
    """Round every entry through a 16-bit float, as a compact index stores it."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))
