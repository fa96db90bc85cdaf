"""Committed runs (S12, S13): a log of runs that survives crashes, replays and concurrent writers.

A store is a folder with ``data/`` (one folder of Parquet files per attempt) and ``commits/`` (numbered JSON files). Version N lists every
live part: its folder, its runs, its rows. Writing a run fills a new data folder and then publishes version N + 1, which names it and
drops the earlier part of the same run: a run written twice counts once, a reader sees the old or the new state whole, and the
folder of a writer that died is named by no version. A version is published by renaming a finished file to a number that must not
exist yet, so of two writers one starts again from the other's version. The driver handles the list of parts (one entry per run,
or per group of compacted runs), never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIES = 20


class Conflict(RuntimeError):
    """Other writers kept publishing first."""


class RunStore:
    """Runs of one schema in the shared folder ``path``. Each row has the column ``run_id`` (a long)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files -----------------------------------------------------------------------------------------------------
    def _hadoop(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._hadoop().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def version(self) -> int:
        """Number of the newest published version; 0 for an empty store."""
        return max((int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """{"parts", "meta"} of a version (default: the newest)."""
        v = self.version() if version is None else version
        if v == 0:
            return {"parts": [], "meta": {}}
        stream = self._fs().open(self._hadoop("commits", f"{v:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def parts(self, version: int | None = None) -> list[dict]:
        """Live parts ({"folder", "runs", "rows", ...}) of a version (default: the newest)."""
        return self.state(version)["parts"]

    def meta(self) -> dict:
        """What writers noted with the newest version."""
        return self.state()["meta"]

    def publish(self, change: Callable[[list[dict]], list[dict] | None], meta: dict | None = None) -> int:
        """Publishes the next version with the parts ``change(parts)`` (None: nothing to do) and ``meta`` added to the notes; starts again
        if another writer came first."""
        fs, jvm = self._fs(), self.spark._jvm
        for attempt in range(RETRIES):
            v = self.version()
            state = self.state(v)
            parts = change(state["parts"])
            if parts is None:
                return v
            draft = self._hadoop("commits", f".{uuid.uuid4().hex}.draft")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps({"version": v + 1, "parts": parts, "meta": state["meta"] | (meta or {})}).encode()))
            out.close()
            none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            try:
                context.rename(draft, self._hadoop("commits", f"{v + 1:012d}.json"), options)
                return v + 1
            except Exception as e:  # noqa: BLE001 - the JVM's error arrives as a py4j error
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                time.sleep(0.01 * attempt)
        raise Conflict(f"{self.path}: {RETRIES} versions were published by others in the meantime")

    # -- runs ------------------------------------------------------------------------------------------------------
    def stage(self, rows: DataFrame) -> dict:
        """Writes ``rows`` (with run_id) into a new data folder that no version names yet; returns the part it will be."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return {"folder": folder, "rows": self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").count()}

    def write_run(self, rows: DataFrame, run_id: int) -> int:
        """``rows`` become the whole of run ``run_id``, replacing what it held before. Returns the version."""
        return self.write_runs({run_id: rows})

    def write_runs(self, runs: dict[int, DataFrame], meta: dict | None = None) -> int:
        """Replaces several runs, and notes ``meta``, in one version: readers see all of it or nothing."""
        parts = [self.stage(rows.withColumn("run_id", F.lit(int(r)).cast("long"))) | {"runs": [int(r)], "mixed": False} for r, rows in runs.items()]
        new = {int(r) for r in runs}

        def change(before):
            kept = [p | {"runs": [r for r in p["runs"] if r not in new]} for p in before]
            return [*(p for p in kept if p["runs"]), *parts]  # a compacted part stays for its other runs

        return self.publish(change, meta)

    def compact(self, keep_newest: int = 1, transform: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Rewrites all runs but the ``keep_newest`` ones as a single part, sorted into ranges of run_id. Readers of either version see
        the same rows; a run replaced meanwhile stays replaced. ``transform`` may drop rows that no reader asks for (superseded versions
        of a key); runs it has seen should not be replaced any more."""
        parts = self.parts()
        newest = sorted({r for p in parts for r in p["runs"]})[-keep_newest:] if keep_newest else []
        old = [p for p in parts if not set(p["runs"]) & set(newest)]
        if len(old) < 2:
            return self.version()
        names = {p["folder"] for p in old}
        rows = self._read(old)
        merged = self.stage((transform(rows) if transform else rows).repartitionByRange("run_id").sortWithinPartitions("run_id"))
        runs = {p["folder"]: p["runs"] for p in old}

        def change(now):
            gone = {p["folder"]: p["runs"] for p in now if p["folder"] in names}
            live = sorted(r for f, before in runs.items() for r in before if r in gone.get(f, []))  # not those replaced since
            return [*([merged | {"runs": live, "mixed": True}] if live else []), *(p for p in now if p["folder"] not in names)]

        return self.publish(change)

    def vacuum(self) -> list[str]:
        """Deletes data folders that the newest version doesn't name (what dead writers, replaced and compacted runs left), and drafts;
        returns their names. Only for a time without writers or readers of older versions."""
        live = {p["folder"] for p in self.parts()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in live]
        for name in gone:
            self._fs().delete(self._hadoop(name), True)
        return gone

    def _read(self, parts: list[dict]) -> DataFrame | None:
        """Rows of the parts' live runs: folders of single runs by one scan, compacted ones with their runs as a pushed-down filter."""
        out = None
        whole = [p for p in parts if not p["mixed"]]
        for some in ([whole] if whole else []) + [[p] for p in parts if p["mixed"]]:
            df = self.spark.read.parquet(*(f"{self.path}/{p['folder']}" for p in some))
            if some[0]["mixed"]:  # compacted: it may hold runs that were replaced since, or that the reader doesn't want
                df = df.where(F.col("run_id").isin(some[0]["runs"]))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def read(self, run_ids=None, version: int | None = None) -> DataFrame | None:
        """Rows of the live runs (or of ``run_ids``) as of a version; other runs' files are not read. None if there are none."""
        parts = self.parts(version)
        if run_ids is not None:
            want = set(run_ids)
            parts = [p | {"runs": [r for r in p["runs"] if r in want]} for p in parts if want & set(p["runs"])]
        return self._read(parts) if parts else None

    def latest(self) -> DataFrame | None:
        """The newest run's rows; its number comes from the list of parts, not from a scan."""
        ids = [r for p in self.parts() for r in p["runs"]]
        return self.read([max(ids)]) if ids else None
