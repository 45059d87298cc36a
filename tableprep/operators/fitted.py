"""What a fitted transform is: its kind, its parameters as data, and the transform these make.

A step is made from its data alone, whether these were just fitted or read back from files, so a saved preprocessor does
to new rows what the fitted one does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Fitted:
    """A transform with fixed parameters.

    `facts` are (source column, strategy, parameter, value) rows for reports. `params` (whatever JSON can hold),
    `tables` (parameters that grow with the data) and `models` are all that a step of that `kind` is made of.
    """

    apply: Transform
    facts: list[tuple[str, str, str, str]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    outputs: dict[str, list[str]] = field(default_factory=dict)
    kind: str = "custom"
    params: dict[str, Any] = field(default_factory=dict)
    models: dict[str, PipelineModel] = field(default_factory=dict)


@dataclass
class StepData:
    """What a step is made from. `new_rows` says that the rows are none of those it was fitted on."""

    params: Mapping[str, Any]
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    models: Mapping[str, PipelineModel] = field(default_factory=dict)
    new_rows: bool = False


MAKERS: dict[str, Callable[[StepData], Transform]] = {}


def step_kind(name: str) -> Callable:
    """Registers how a step of that kind is made from its data."""

    def register(maker: Callable[[StepData], Transform]) -> Callable[[StepData], Transform]:
        MAKERS[name] = maker
        return maker

    return register


def make(
    kind: str, params: dict[str, Any], *, facts: list | None = None, outputs: dict[str, list[str]] | None = None,
    tables: dict[str, DataFrame] | None = None, models: dict[str, PipelineModel] | None = None,
) -> Fitted:
    """A fitted step from its data."""
    tables, models = tables or {}, models or {}
    return Fitted(MAKERS[kind](StepData(params, tables, models)), facts or [], tables, outputs or {}, kind, params, models)


def fact(column: str, strategy: str, name: str, value: Any) -> tuple[str, str, str, str]:
    return column, strategy, name, "" if value is None else str(value)


@step_kind("unchanged")
def _unchanged(data: StepData) -> Transform:
    return lambda df: df


@step_kind("drop")
def _dropped(data: StepData) -> Transform:
    return lambda df: df.drop(*data.params["columns"])


def unchanged(columns: list[str]) -> Fitted:
    return make("unchanged", {}, facts=[fact(c, "none", "", None) for c in columns], outputs={c: [c] for c in columns})


def dropped(columns: list[str]) -> Fitted:
    return make("drop", {"columns": columns}, facts=[fact(c, "drop", "", None) for c in columns], outputs={c: [] for c in columns})


def custom(columns: list[str], function: Transform, name: str = "") -> Fitted:
    """A user's own DataFrame -> DataFrame step, which is asked for by `name` when the steps are read back."""
    facts = [fact(c, "custom", "function", getattr(function, "__name__", "")) for c in columns]
    return Fitted(function, facts, kind="custom", params={"name": name, "columns": columns})
