"""Named collections read with a declared schema, held by any name.

A collection is read with ``spark.read.format(f).options(...).schema(S)``:
``f`` is ``mongodb`` with ``database`` / ``collection`` options in a
document-store deployment, or any file format with a path. The registry keeps
how a collection is read, never a DataFrame: every ``get`` reads anew, so a
report reflects the data at the time it is asked for. A DataFrame holds the
files that were there when it was got, so all parts of a report that are
computed from one ``get`` see the same rows. (To compare two moments run a
query for each: within one, Spark takes two reads of a path for the same.)
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


class CollectionRegistry:
    """Collections by name: any string, as in a document store.

    For SQL each one also has a temp view with a generated name,
    ``view_name(name)``; it shows what the last ``get`` (or ``refresh``) read.

    ``batches=True`` reads a path that a ``BatchSink`` writes: the committed
    batches at the time of the ``get``, none of them half.
    """

    def __init__(self, spark: SparkSession, format: str = "parquet", **options: Any):
        self.spark = spark
        self.format = format
        self.options = options
        self._entries: dict[str, dict[str, Any]] = {}
        self._watches: dict[str, tuple[StreamingQuery, Callable[[], None] | None]] = {}

    def _read(self, entry: dict[str, Any]) -> DataFrame:
        if entry["batches"]:
            from ..streaming.batches import BatchList

            return BatchList(self.spark, entry["path"]).snapshot().rows(self.spark, entry["schema"], entry["format"])
        reader = self.spark.read.format(entry["format"]).options(**entry["options"]).schema(entry["schema"])
        return reader.load(entry["path"]) if entry["path"] is not None else reader.load()

    def set(
        self,
        name: str,
        schema: StructType,
        path: str | None = None,
        format: str | None = None,
        batches: bool = False,
        **options: Any,
    ) -> DataFrame:
        """(Re)register collection ``name`` with ``schema`` and its view, and read it."""
        if batches and path is None:
            raise ValueError("batches=True needs the sink's path")
        entry = {
            "schema": schema,
            "path": path,
            "batches": batches,
            "format": format or self.format,
            "options": {**self.options, **options},
        }
        if entry["format"] == "mongodb":
            entry["options"].setdefault("collection", name)
        df = self._read(entry)
        entry["view"] = self._entries.get(name, {}).get("view") or f"collection_{uuid.uuid4().hex}"
        self._entries[name] = entry
        return self._hold(name, df)

    def _hold(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(self._entries[name]["view"])
        return df

    def view_name(self, name: str) -> str:
        """The temp view of a registered collection in the registry's session."""
        return self._entries[name]["view"]

    def add(self, name: str, schema: StructType, path: str | None = None, format: str | None = None, **options: Any) -> DataFrame:
        """Register ``name`` unless it is already known (then a warning, and what is known stays)."""
        if name in self._entries:
            log.warning("collection %r is already registered", name)
            return self.refresh(name)
        return self.set(name, schema, path, format, **options)

    def get(self, name: str) -> DataFrame | None:
        """The collection as it is now (new file listing), or ``None`` (with a warning) if unknown. Take one
        per report: its parts then agree."""
        if name not in self._entries:
            log.warning("collection %r is not registered", name)
            return None
        return self.refresh(name)

    def schema(self, name: str) -> StructType:
        return self._entries[name]["schema"]

    def roots(self, name: str) -> list[str]:
        """The folders that hold the collection's files now: its path, or those of its committed batches."""
        entry = self._entries[name]
        if entry["path"] is None:
            raise ValueError(f"collection {name!r} is no folder of files")
        if entry["batches"]:
            from ..streaming.batches import BatchList

            return BatchList(self.spark, entry["path"]).snapshot().folders()
        return [entry["path"]]

    def names(self) -> list[str]:
        return list(self._entries)

    def refresh(self, name: str) -> DataFrame:
        """Re-read a registered collection (new file listing, same schema)."""
        return self._hold(name, self._read(self._entries[name]))

    def remove(self, name: str) -> bool:
        """Unregister ``name`` and stop its watch; ``False`` (with a warning)
        if it was not registered."""
        if name not in self._entries:
            log.warning("collection %r is not registered", name)
            return False
        self.stop_watch(name)
        self.spark.catalog.dropTempView(self._entries.pop(name)["view"])
        return True

    def watch(self, name: str, changes: DataFrame, checkpoint_location: str, **kwargs: Any) -> StreamingQuery:
        """Refresh ``name`` whenever ``changes`` (a streaming change feed)
        reports an insert, update, replace or delete; see
        ``streaming.watch_collection`` for ``report`` / ``report_path`` /
        ``trigger``."""
        from ..streaming.refresh import watch_collection

        return watch_collection(self, name, changes, checkpoint_location, **kwargs)

    def attach_watch(self, name: str, query: StreamingQuery, drain: Callable[[], None] | None = None) -> None:
        """Remember the refresh query of ``name`` so ``remove``/``stop_all`` stop it; ``drain`` ends it
        after the batch it is at."""
        self.stop_watch(name)
        self._watches[name] = (query, drain)

    def stop_watch(self, name: str, drain: bool = False) -> None:
        """Stop the watch of ``name``: at once (a running batch is cancelled, and done again by the next watch
        with its checkpoint), or with ``drain`` between two batches."""
        query, end = self._watches.pop(name, (None, None))
        if query is None or not query.isActive:
            return
        if drain and end is not None:
            end()
        else:
            query.stop()

    def stop_all(self, drain: bool = False) -> None:
        """Stop every watch (collections stay registered)."""
        for name in list(self._watches):
            self.stop_watch(name, drain)
