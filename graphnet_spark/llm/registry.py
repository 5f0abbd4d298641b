"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, importance, licenses, media, mixing, near_dedup, nn_descent, packing, pii, quality, suffix_dedup, warc, window_dedup

MODULES = (quality, media, mixing, near_dedup, suffix_dedup, warc, licenses, window_dedup, packing, pii, nn_descent, alignment, importance)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
