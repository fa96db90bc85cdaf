"""A log that grows by runs and keeps W1's task statistics beside it, so E10 labels need no pass over the log for them.

Each run stores its rows and, per (split, task), the smallest and largest performance and cost of its own rows. Minima and maxima
merge, so the statistics of the whole log are those few rows merged; a run that is written again replaces its own rows in
both. A new day reads only itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routelake.operators import labels as L
from routelake.sources.runs import RunStore


class ScoredLog:
    """Runs of log rows (``rows``) and of their statistics (``parts``), both committed by run id."""

    def __init__(self, spark: SparkSession, path: str, reprice_pattern: str = L.REPRICE_PATTERN):
        self.rows, self.parts = RunStore(spark, f"{path}/rows"), RunStore(spark, f"{path}/stats")
        self.pattern = reprice_pattern

    def write_run(self, log: DataFrame, run_id: int) -> None:
        """``log`` becomes the whole of run ``run_id``. It is evaluated once: the statistics are taken from the written rows. A writer that
        dies between the two leaves statistics of the run's earlier rows, which the next write of the run replaces; ``consistent`` tells."""
        self.rows.write_run(log, run_id)
        self.parts.write_run(L.range_stats(L.eval_columns(self.rows.read([run_id]), self.pattern), L.NORMALISED, L.NORMALISED_BY), run_id)
        self.parts.publish(lambda parts: parts, {f"run {run_id}": self._folder(run_id)})

    def _folder(self, run_id: int) -> str | None:
        return next((p["folder"] for p in self.rows.parts() if run_id in p["runs"] and not p["mixed"]), None)

    def consistent(self) -> bool:
        """Every live run's statistics were taken from its live rows."""
        noted = self.parts.meta()
        runs = {r for p in self.rows.parts() for r in p["runs"]}
        return all(noted.get(f"run {r}") == self._folder(r) for r in runs)

    def stats(self) -> DataFrame:
        """W1's statistics of the whole log, from a row per run, split and task."""
        return L.merge_range_stats(self.parts.read(), L.NORMALISED, L.NORMALISED_BY)

    def labels(self, run_ids=None) -> DataFrame:
        """E10 of the whole log, or of some runs only, normalised over the whole log either way."""
        if not self.consistent():
            raise ValueError("a run's statistics are older than its rows: write the run again")
        return L.route_labels(self.rows.read(run_ids), self.pattern, self.stats())
