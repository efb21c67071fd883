"""Which batches of a path sink count: a list that is written last and read first.

A path sink writes every micro-batch to a folder of its own and then enters it
in the list, ``{path}/_batches``: a file per committed batch, and now and then a
*state* that stands for all entries up to a batch of each query. A reader takes
the list first (``snapshot``) and then reads the folders it names. So a batch
being written, or half written by a job that died, is not seen, and two
reports over one snapshot see the same rows however many batches arrive
meanwhile.

``compact`` keeps the number of folders small: when ``fan_in`` folders of a
tier have gathered they are rewritten as one folder of the next tier, so a row
is rewritten as often as the logarithm of the number of batches. The new state
replaces the list in one step; the batches it covers stay known, and one that
is replayed is left out. ``clean`` removes what no recent state needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.shared_files import SharedFiles

LIST = "_batches"
MERGED = "_merged"  # rewritten batches: hidden from readers that do not ask the list


@dataclass(frozen=True)
class Snapshot:
    """The folders that count at one moment, and what the list knew then."""

    path: str
    tiers: tuple[tuple[str, int], ...] = ()  # (folder below path, tier)
    through: dict[str, int] = field(default_factory=dict)  # last batch of each query
    number: int = 0  # of the state it is based on
    replaced: tuple[str, ...] = ()  # folders whose rows are in others now

    def folders(self) -> list[str]:
        return [f"{self.path}/{folder}" for folder, _ in self.tiers]

    def rows(self, spark: SparkSession, schema: StructType, format: str = "parquet") -> DataFrame:
        """The rows of these folders, as declared by ``schema``."""
        if not self.tiers:
            return spark.createDataFrame([], schema)
        return spark.read.format(format).schema(schema).load(self.folders())


class BatchList:
    """The list of committed batches of the sink at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.folder = f"{self.path}/{LIST}"
        self.files = SharedFiles(spark)
        self.spark = spark

    def there(self) -> bool:
        return self.files.exists(self.folder)

    def commit(self, query: str, batch_id: int, folder: str) -> None:
        """Enter a batch whose ``folder`` (below the path) is wholly written."""
        entry = {"query": query, "batch": batch_id, "folder": folder}
        self.files.create(f"{self.folder}/entry-{query}-{batch_id}.json", json.dumps(entry))

    def committed(self, query: str, batch_id: int) -> bool:
        """Whether the batch has an entry or a state that stands for it: two small reads, however long the list."""
        if self.files.exists(f"{self.folder}/entry-{query}-{batch_id}.json"):
            return True
        state = None
        while state is None:
            state = self._state(self.files.names(self.folder))
        return state["through"].get(query, -1) >= batch_id

    def _state(self, names: list[str]) -> dict | None:
        """The latest state; None if it was replaced since ``names`` were listed."""
        states = [n for n in names if n.startswith("state-")]
        if not states:
            return {"number": 0, "tiers": [], "through": {}, "replaced": []}
        text = self.files.read(f"{self.folder}/{states[-1]}")
        return None if text is None else json.loads(text)

    def snapshot(self) -> Snapshot:
        """What counts now. A state replaced while it was being read is looked up again."""
        while True:
            names = self.files.names(self.folder)
            state = self._state(names)
            if state is None:
                continue
            tiers, through = [tuple(t) for t in state["tiers"]], dict(state["through"])
            entries = []
            for name in names:
                if name.startswith("entry-"):
                    query, _, batch = name[len("entry-") : -len(".json")].rpartition("-")
                    if int(batch) > state["through"].get(query, -1):
                        entries.append((query, int(batch), name))
            texts = [self.files.read(f"{self.folder}/{name}") for *_, name in entries]
            if None in texts:
                continue
            for (query, batch, _), text in zip(entries, texts):
                tiers.append((json.loads(text)["folder"], 0))
                through[query] = max(batch, through.get(query, -1))
            return Snapshot(self.path, tuple(tiers), through, state["number"], tuple(state["replaced"]))

    def compact(self, schema: StructType, format: str = "parquet", fan_in: int = 10, target_bytes: int = 512 << 20) -> Snapshot:
        """Merge every tier that has ``fan_in`` folders or more into one folder of the next, in files of about
        ``target_bytes``. If another compaction comes first, this one's work is dropped and its list stands."""
        seen = self.snapshot()
        tiers, replaced, made = list(seen.tiers), list(seen.replaced), []
        tier = 0
        while tier <= max((t for _, t in tiers), default=-1):
            full = [f for f, t in tiers if t == tier]
            if len(full) >= fan_in:
                merged = f"{MERGED}/tier={tier + 1}/{uuid.uuid4().hex}"
                rows = self.spark.read.format(format).schema(schema).load([f"{self.path}/{f}" for f in full])
                size = sum(self.files.size(f"{self.path}/{f}") for f in full)
                rows.coalesce(max(1, -(-size // target_bytes))).write.format(format).mode("error").save(f"{self.path}/{merged}")
                tiers = [(f, t) for f, t in tiers if t != tier] + [(merged, tier + 1)]
                replaced += full
                made.append(merged)
            tier += 1
        state = {"number": seen.number + 1, "tiers": tiers, "through": seen.through, "replaced": replaced}
        if not self.files.create(f"{self.folder}/state-{state['number']:012d}.json", json.dumps(state)):
            for merged in made:
                self.files.delete(f"{self.path}/{merged}")
        return self.snapshot()

    def clean(self, keep_states: int = 2) -> int:
        """Remove replaced folders, old states and covered entries that none of the last ``keep_states`` states
        needs; returns the number of folders removed. Readers of older snapshots must have ended."""
        names = self.files.names(self.folder)
        states = [n for n in names if n.startswith("state-")]
        if len(states) < keep_states:
            return 0
        kept = [json.loads(self.files.read(f"{self.folder}/{n}")) for n in states[-keep_states:]]
        oldest, needed = kept[0], {f for s in kept for f, _ in s["tiers"]}
        for name in names:
            query, _, batch = name[len("entry-") : -len(".json")].rpartition("-")
            if name.startswith("entry-") and int(batch) <= oldest["through"].get(query, -1):
                self.files.delete(f"{self.folder}/{name}")
        for name in states[:-keep_states]:
            self.files.delete(f"{self.folder}/{name}")
        return sum(self.files.delete(f"{self.path}/{f}") for f in kept[-1]["replaced"] if f not in needed)
