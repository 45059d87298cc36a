"""Numeric scaling with parameters from one fused aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.columns import present
from tableprep.operators.fitted import Fitted, StepData, Transform, fact, make, step_kind
from tableprep.operators.fitting import Answers, Fit, fit_together


PARAMETERS = {"standard": ("mean", "std"), "minmax": ("min", "range"), "robust": ("median", "iqr")}


def scaling_fit(df: DataFrame, columns: list[str], scaling: str) -> Fit:
    """standard, minmax, robust or log. A constant column scales to 0."""
    outputs = {c: [c] for c in columns}
    if scaling == "log":
        return Fit(columns, columns, lambda found: make("log", {"columns": columns}, facts=[fact(c, scaling, "", None) for c in columns], outputs=outputs))
    scalars: dict[str, Column] = {}
    for c in columns:
        x = present(df, c).cast("double")
        if scaling == "standard":
            scalars |= {f"a {c}": F.avg(x), f"b {c}": F.stddev_samp(x)}
        elif scaling == "minmax":
            scalars |= {f"a {c}": F.min(x), f"b {c}": F.max(x) - F.min(x)}

    def build(found: Answers) -> Fitted:
        if scaling == "robust":
            pairs = {c: (m, None if m is None else hi - lo) for c, (lo, m, hi) in found.quantiles.items()}
        else:
            pairs = {c: (found.scalars[f"a {c}"], found.scalars[f"b {c}"]) for c in columns}
        facts = [fact(c, scaling, n, v) for c in columns for n, v in zip(PARAMETERS[scaling], pairs[c])]
        return make("scale", {"pairs": {c: list(p) for c, p in pairs.items()}}, facts=facts, outputs=outputs)

    quartiles = {c: [0.25, 0.5, 0.75] for c in columns} if scaling == "robust" else {}
    return Fit(columns, columns, build, scalars=scalars, quantiles=quartiles)


@step_kind("scale")
def _scaled(data: StepData) -> Transform:
    return lambda rows: rows.withColumns({c: shifted(present(rows, c), *pair) for c, pair in data.params["pairs"].items()})


@step_kind("log")
def _logged(data: StepData) -> Transform:
    return lambda rows: rows.withColumns({c: log_scaled(present(rows, c)) for c in data.params["columns"]})


def fit_scaling(df: DataFrame, columns: list[str], scaling: str) -> Fitted:
    return fit_together(df, [scaling_fit(df, columns, scaling)])[0]


def shifted(x: Column, centre: float | None, width: float | None) -> Column:
    x = x.cast("double")
    if not width or centre is None:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(centre)) / F.lit(width)


def log_scaled(x: Column) -> Column:
    """log1p; null where it is not defined."""
    x = x.cast("double")
    return F.when(x > -1, F.log1p(x))
