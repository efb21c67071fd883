"""Reports kept up to date from the files that changed.

A report is a sum over groups of counts (``ReportCounts``), so the counts of
each *file* can be kept apart: a refresh counts the files that are new or were
rewritten, forgets those that are gone, and adds up what is there. An insert, an
update or a delete shows as files that come and go; the rest of the collection
is not read again.

State below ``state_path``: folders of counts per file (one per refresh that
found new files, merged into one when there are many), the listing they belong
to, and a pointer that names both, replaced last. A refresh that dies leaves
folders that nothing names. A file is what its path, size and time of
modification say; counts of a file that changed while it was being read are
not kept, and the refresh begins again.

Only collections of files can be kept this way: a removal must be
attributable to the rows it removed. For connectors give ``watch`` a plain
``report``, which reads the collection anew.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.fine_report import fine_counts_by, fine_rows_from
from ..operators.master_report import master_counts_by, master_rows_from
from ..operators.metrics import Filters
from ..sources.shared_files import SharedFiles

FILE = ["_file", "_size", "_time"]
MERGE_FROM = 16  # folders of counts
TRIES = 5


@dataclass(frozen=True)
class ReportCounts:
    """A report as counts per group (``count``: rows and extra grouping columns to counts) and what it
    makes of their sums (``finish``)."""

    count: Callable[[DataFrame, list[str]], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


FINE_REPORT = ReportCounts(fine_counts_by, fine_rows_from)


def master_report_counts(filters: Filters = None) -> ReportCounts:
    return ReportCounts(
        lambda rows, by: master_counts_by(rows, by, filters), lambda counts: master_rows_from(counts, filters)
    )


class IncrementalReport:
    """A report over the files below ``roots()``: a path of files, or the folders of a batch list."""

    def __init__(
        self,
        spark: SparkSession,
        roots: Callable[[], list[str]],
        schema: StructType,
        state_path: str,
        report: ReportCounts = FINE_REPORT,
        format: str = "parquet",
    ):
        self.spark, self.roots, self.schema = spark, roots, schema
        self.state, self.report, self.format = state_path.rstrip("/"), report, format
        self.files = SharedFiles(spark)

    def _tagged(self, rows: DataFrame) -> DataFrame:
        names = ("file_path", "file_size", "file_modification_time")
        return rows.withColumns({c: F.col(f"_metadata.{n}") for c, n in zip(FILE, names)})

    def _listing(self, roots: list[str]) -> DataFrame:
        """The files there are, without reading them."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        return self._tagged(files).select(*FILE)

    def _rows(self, paths: list[str], roots: list[str]) -> DataFrame:
        reader = self.spark.read.format(self.format).schema(self.schema)
        if len(roots) == 1:
            reader = reader.option("basePath", roots[0])  # folders may carry columns
        return reader.load(paths)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.state}/{f}" for f in folders))

    def refresh(self, _: DataFrame | None = None) -> DataFrame:
        """Count what changed, remember it, and return the report's rows."""
        for _try in range(TRIES):
            known = json.loads(self.files.read(f"{self.state}/current.json") or "{}")
            roots = self.roots()
            listing = f"listing-{uuid.uuid4().hex}"
            if roots:
                self._listing(roots).write.parquet(f"{self.state}/{listing}")
            else:
                self.spark.createDataFrame([], "_file string, _size bigint, _time timestamp").write.parquet(f"{self.state}/{listing}")
            there, counts = self._read([listing]), list(known.get("counts", []))
            fresh = self.new_rows(roots, there, known)
            if fresh is not None:
                made = f"counts-{uuid.uuid4().hex}"
                self.report.count(self._tagged(fresh), FILE).write.parquet(f"{self.state}/{made}")
                if not self._read([made]).join(there, FILE, "left_anti").isEmpty():
                    continue  # a file changed since it was listed
                counts.append(made)
            if len(counts) >= MERGE_FROM:
                merged = f"counts-{uuid.uuid4().hex}"
                self._live(counts, there).write.parquet(f"{self.state}/{merged}")
                counts = [merged]
            now = {"counts": counts, "listing": listing}
            self.files.replace(f"{self.state}/current.json", json.dumps({**now, "before": {k: known.get(k) for k in now}}))
            self._clean(known, now)
            return self.rows()
        raise RuntimeError("the collection's files changed during every try")

    def new_rows(self, roots: list[str], there: DataFrame, known: dict) -> DataFrame | None:
        """The rows of the files in ``there`` that the state ``known`` has not counted; None if there are none."""
        if not known:
            return self._rows(roots, roots) if roots else None
        new = there.join(self._read([known["listing"]]), FILE, "left_anti").select("_file")
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["_file"]) for r in new.collect()]  # as many as changed
        return self._rows(paths, roots) if paths else None

    def _live(self, counts: list[str], there: DataFrame) -> DataFrame:
        """Counts of the files that are there."""
        return self._read(counts).join(there, FILE, "left_semi")

    def rows(self) -> DataFrame:
        """The report's rows as of the last refresh."""
        known = json.loads(self.files.read(f"{self.state}/current.json") or "{}")
        if not known:
            raise RuntimeError("nothing was refreshed yet")
        if not known["counts"]:
            empty = self.spark.createDataFrame([], self.schema)
            return self.report.finish(self.report.count(empty, []))
        return self.report.finish(self._live(known["counts"], self._read([known["listing"]])))

    def _clean(self, known: dict, now: dict) -> None:
        """Remove what neither this state nor the one before names."""
        before = known.get("before") or {}
        kept = {*now["counts"], now["listing"], *known.get("counts", []), known.get("listing")}
        for folder in {*(before.get("counts") or []), before.get("listing")} - kept - {None}:
            self.files.delete(f"{self.state}/{folder}")
