"""A state log with snapshots: appended batches, folded now and then into a snapshot that a pointer names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.sources.state import latest
from litweave.sources.store import read_table

_POINTERS = "version long, snapshot string, folded array<string>"


class StateLog:
    """Versions of keyed rows below `path`.

    `log/batch=…` holds appended batches, `snapshots/…` the newest rows of all batches folded so far, and
    `pointers` one row per compaction. The pointer row is written last, so a compaction that dies leaves only
    a snapshot nobody reads. The newest row of a key is the same if a batch is read twice, so a
    batch that arrives while a snapshot is made is never lost: it is not among the folded ones.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, keys: Sequence[str], order: Sequence[str]) -> None:
        self.spark, self.path, self.ddl, self.keys, self.order = spark, path.rstrip("/"), ddl, list(keys), list(order)

    def append(self, rows: DataFrame) -> None:
        """Add versions; they appear together."""
        columns = [part.split()[0] for part in self.ddl.split(", ")]
        rows.select(*columns).write.parquet(f"{self.path}/log/batch={uuid.uuid4().hex}")

    def _pointer(self) -> tuple[int, str | None, list[str]]:
        found = read_table(self.spark, f"{self.path}/pointers", _POINTERS).orderBy(F.desc("version"), F.desc("snapshot")).first()
        return (found["version"], found["snapshot"], list(found["folded"])) if found else (0, None, [])

    def _batches(self) -> DataFrame:
        return read_table(self.spark, f"{self.path}/log", f"{self.ddl}, batch string")

    def _versions(self, snapshot: str | None, folded: list[str]) -> DataFrame:
        """The snapshot and the batches it does not hold; folded ones are left out by their folder."""
        tail = self._batches().where(~F.col("batch").isin(folded)).drop("batch")
        return tail.unionByName(read_table(self.spark, f"{self.path}/snapshots/{snapshot}", self.ddl)) if snapshot else tail

    def read(self) -> DataFrame:
        """The newest version of every key."""
        _, snapshot, folded = self._pointer()
        return latest(self._versions(snapshot, folded), self.keys, self.order)

    def compact(self) -> None:
        """Fold all batches there are into a new snapshot and point to it."""
        version, snapshot, folded = self._pointer()
        # The names of a few batches, not their rows; those that come later stay in the tail.
        present = [r[0] for r in self._batches().select("batch").distinct().collect()]
        fresh = [b for b in present if b not in folded]
        if not fresh:
            return
        name = uuid.uuid4().hex
        seen = self._batches().where(F.col("batch").isin(fresh)).drop("batch")
        if snapshot:
            seen = seen.unionByName(read_table(self.spark, f"{self.path}/snapshots/{snapshot}", self.ddl))
        latest(seen, self.keys, self.order).write.parquet(f"{self.path}/snapshots/{name}")
        row = self.spark.createDataFrame([(version + 1, name, sorted(present))], _POINTERS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")
