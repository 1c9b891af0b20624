"""The execution path of a query: Spark's own formatted plan, line by line."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def execution_path(df: DataFrame) -> list[str]:
    """Lines of the physical plan with its numbered operators. Nothing is executed."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return [line for line in out.getvalue().splitlines() if line.strip()]
