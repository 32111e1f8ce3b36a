"""Named queries over the driver's tables, with the SQL that checks them.

A query takes (spark, sf_dir) and only wires a source to operators; scores are whole hundredths, so that sums
are exact and both engines agree bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelia.plans import joins, kernels, labels, panels, records, reports, resampled, scalars, statistics

MODULES = (panels, joins, scalars, statistics, records, kernels, labels, resampled, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
