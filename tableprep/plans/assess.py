"""From a table to its profile, roles, issues and default plan."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators import profile, quality, roles
from tableprep.plans import defaults
from tableprep.session import materialize


@dataclass
class Assessment:
    """What is known about one table or a catalog; every table here has one row per column or issue."""

    tables: DataFrame
    columns: DataFrame
    roles: DataFrame
    rollup: DataFrame
    issues: DataFrame
    summary: DataFrame

    def plan(self, dataset_name: str, input_files: list[str], output: str = "prepared") -> dict[str, Any]:
        """The default plan document of one dataset."""
        mine = F.col("dataset_name") == F.lit(dataset_name)
        header = defaults.plan_header(self.rollup, self.summary).where(mine).first().asDict()
        columns = [r.asDict() for r in defaults.column_plan(self.columns, self.roles).where(mine).collect()]
        return defaults.default_plan(header, columns, input_files, output)


def assess(df: DataFrame, dataset_name: str, task: roles.Tasks = None, **options: Any) -> Assessment:
    """Profile a table once, write the profile, and derive the rest from it."""
    return _derive(
        profile.table_profile(df, dataset_name),
        profile.column_profile(df, dataset_name, median=options.pop("median", "none"), **options),
        task, False,
    )


def assess_catalog(tables: Mapping[str, DataFrame], tasks: Mapping[str, roles.Tasks], **options: Any) -> Assessment:
    return _derive(
        profile.catalog_tables(dict(tables)),
        profile.catalog_profile(dict(tables), median=options.pop("median", "none"), **options),
        tasks, True,
    )


def _derive(tables: DataFrame, columns: DataFrame, tasks: Any, by_dataset: bool) -> Assessment:
    with ThreadPoolExecutor(2) as pool:  # the two profiles share no work, so they run side by side
        written = pool.submit(materialize, tables, "tables"), pool.submit(materialize, columns, "columns")
        tables, columns = (w.result() for w in written)
    inferred = materialize(roles.column_roles(columns, tasks, by_dataset=by_dataset), "roles")
    rollup = roles.table_roles(inferred)
    issues = quality.quality_issues(tables, columns, inferred, rollup, tasks, by_dataset=by_dataset)
    return Assessment(tables, columns, inferred, rollup, issues, quality.quality_summary(tables, issues))
