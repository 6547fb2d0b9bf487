"""Checks of data, in one pass over the rows, and of parameters; a failed check raises with what it found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """One row: how many rows break each rule; null breaks it too."""
    return rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def require(rows: DataFrame, **rules: Column) -> DataFrame:
    """rows, if all of them keep the rules."""
    found = violations(rows, **rules).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ValueError("rows break rules: " + ", ".join(f"{k} ({n})" for k, n in broken.items()))
    return rows


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def finite_array(x: Column) -> Column:
    """An array all of whose numbers are finite."""
    return x.isNotNull() & F.forall(x, finite)


def option_index(x: Column, n_options: int) -> Column:
    """A whole number from 0 to n_options - 1."""
    return finite(x) & (x == F.round(x)) & (x >= 0) & (x < n_options)


def count(x: Column) -> Column:
    """A whole number, not negative."""
    return finite(x) & (x == F.round(x)) & (x >= 0)


def binary(x: Column) -> Column:
    return finite(x) & ((x == 0) | (x == 1))


def inside(x: Column, low: float, high: float) -> Column:
    return finite(x) & (x >= low) & (x <= high)


def nonnegative(x: Column) -> Column:
    return finite(x) & (x >= 0)


def distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """An array of chances that sum to 1."""
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    return finite_array(p) & F.forall(p, lambda v: v >= 0) & (F.abs(total - 1) <= tolerance)


# ---------------------------------------------------------------- parameters


def scalar(x, name: str, positive: bool = False, nonnegative: bool = False) -> float:
    value = np.asarray(x, float)
    if value.shape or not np.isfinite(value):
        raise ValueError(f"{name} is one finite number, not {x!r}")
    if (positive and value <= 0) or (nonnegative and value < 0):
        raise ValueError(f"{name} is {'positive' if positive else 'not negative'}, not {x!r}")
    return float(value)


def array(x, name: str, shape: tuple[int, ...] | None = None, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """A finite array of the shape with numbers from low to high."""
    value = np.asarray(x, float)
    if shape is not None and value.shape != shape:
        raise ValueError(f"{name} has shape {value.shape}, not {shape}")
    if not np.isfinite(value).all() or (value < low).any() or (value > high).any():
        raise ValueError(f"{name} holds numbers that are not finite or not from {low} to {high}")
    return value


def covariance(x, name: str = "covariance", definite: bool = True, tolerance: float = 1e-8) -> np.ndarray:
    """One symmetric matrix, or one for each state in front, without negative eigenvalues (all positive, if definite)."""
    value = array(x, name)
    if value.ndim not in (2, 3) or value.shape[-1] != value.shape[-2]:
        raise ValueError(f"{name} is not square")
    for k, one in enumerate(value.reshape(-1, *value.shape[-2:])):
        if not np.allclose(one, one.T, rtol=1e-6, atol=tolerance):
            raise ValueError(f"{name} of state {k} is not symmetric")
        least = np.linalg.eigvalsh((one + one.T) / 2)[0]
        if least < -tolerance or (definite and least <= 0):
            raise ValueError(f"{name} of state {k} has the eigenvalue {least:.3g}")
    return value


def probabilities(x, name: str = "probabilities", tolerance: float = 1e-6) -> np.ndarray:
    value = array(x, name, low=0.0)
    if value.ndim != 1 or abs(value.sum() - 1) > tolerance:
        raise ValueError(f"{name} do not sum to 1")
    return value


def chain(x, name: str = "transitions", tolerance: float = 1e-6) -> np.ndarray:
    """A square matrix whose rows sum to 1."""
    value = array(x, name, low=0.0)
    if value.ndim != 2 or value.shape[0] != value.shape[1] or np.abs(value.sum(1) - 1).max() > tolerance:
        raise ValueError(f"rows of {name} do not sum to 1")
    return value


def switching(model) -> None:
    """Shapes and contents of a switching model."""
    K, d = model.m0.shape
    array(model.m0, "m0")
    array(model.A, "A", (K, d, d))
    covariance(array(model.Q, "Q", (K, d, d)), "Q", definite=False)
    covariance(array(model.P0, "P0", (K, d, d)), "P0", definite=False)
    chain(array(model.Z, "Z", (K, K)), "Z")
    probabilities(array(model.prior, "prior", (K,)), "prior")
