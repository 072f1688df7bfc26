"""Jobs of several steps whose log survives a failure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = "step int, name string, state string, message string"


def run_logged(
    spark: SparkSession, steps: Sequence[tuple[str, Callable[[], object]]],
) -> tuple[list, DataFrame]:
    """Run steps in order; returns their results and one log row per step.

    A failing step is logged and ends the job, the steps after it are logged as skipped. What
    earlier steps returned and logged is not lost.
    """
    results, log, failed = [], [], False
    for number, (name, work) in enumerate(steps, start=1):
        if failed:
            log.append((number, name, "SKIPPED", None))
            continue
        try:
            results.append(work())
            log.append((number, name, "DONE", None))
        except Exception as problem:  # noqa: BLE001 - any failure belongs in the log
            failed = True
            log.append((number, name, "ERROR", str(problem)))
    return results, spark.createDataFrame(log, LOG_SCHEMA)
