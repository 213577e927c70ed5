"""An append-only table of batches, each of which counts once, on any file system that Spark writes to.

Writing a batch has two steps: its rows go to a folder of their own, then a manifest that names all live folders is put in place
under the batch's number, whole or not at all. A batch whose number has a manifest is known: a replay of it adds nothing. Rows that a
killed writer left have no manifest and are never read, and of two writers of one number one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Folders of rows after which a ledger's rows are rewritten as one.
MOST_FOLDERS = 64


class Ledger:
    """Rows in ``folder``, on any file system that Spark writes to. ``merge``: what rows become when folders are rewritten as one, such as
    sums of partial sums; merging twice must do no harm."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] | None = None, most_folders: int = MOST_FOLDERS):
        self.spark, self.folder, self.merge, self.most_folders = spark, folder.rstrip("/"), merge, most_folders

    def _manifest(self, batch: int) -> str:
        return f"{self.folder}/manifests/{batch:012d}.json"

    def last(self) -> int:
        """The number of the newest batch; -1 for none."""
        return max((int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.folder}/manifests") if n.endswith(".json")), default=-1)

    def _live(self, batch: int) -> list[str]:
        return json.loads(files.read_text(self.spark, self._manifest(batch)))["folders"] if batch >= 0 else []

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch and tells whether it was new. Numbers must grow; those of a Structured Streaming query do, over restarts too."""
        last = self.last()
        if batch <= last:
            return False
        live = self._live(last)
        if len(live) >= self.most_folders:
            rows, live = self._of(live).unionByName(rows), []
            rows = self.merge(rows) if self.merge else rows
        self._commit(batch, [*live, self._written(rows)])
        return True

    def add(self, rows: DataFrame) -> int:
        """Adds rows under the next number, which it returns; where another writer takes that one first, the one behind it."""
        name = self._written(rows)
        while True:
            last = self.last()
            try:
                self._commit(last + 1, [*self._live(last), name])
                return last + 1
            except FileExistsError:
                continue

    def _written(self, rows: DataFrame) -> str:
        name = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _commit(self, batch: int, folders: list[str]) -> None:
        files.write_new(self.spark, self._manifest(batch), json.dumps({"batch": batch, "folders": folders}))

    def _of(self, live: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{n}" for n in live])

    def is_empty(self) -> bool:
        return self.last() < 0

    def read(self) -> DataFrame:
        """The rows of all batches so far. An empty ledger has no schema and is an error."""
        live = self._live(self.last())
        if not live:
            raise FileNotFoundError(f"{self.folder} has no batch yet")
        return self._of(live)

    def vacuum(self, keep: int = 10) -> int:
        """Removes manifests but the newest ``keep``, and folders of rows that none of those names; the number of folders removed. Not while a
        writer is at work: what it wrote has no manifest yet."""
        numbers = sorted(n for n in files.names(self.spark, f"{self.folder}/manifests") if n.endswith(".json"))
        named = {f for n in numbers[-keep:] for f in self._live(int(n.removesuffix(".json")))}
        stale = [n for n in files.names(self.spark, f"{self.folder}/rows") if f"rows/{n}" not in named]
        for n in stale:
            files.remove(self.spark, f"{self.folder}/rows/{n}")
        for n in numbers[:-keep]:
            files.remove(self.spark, f"{self.folder}/manifests/{n}")
        return len(stale)

    def follow(self, stream: DataFrame, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> None:
        """Appends a stream's batches, ``each`` applied first, until what is there has been read (or by another ``trigger``)."""

        def put(rows: DataFrame, batch: int) -> None:
            self.append(each(rows) if each else rows, batch)

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()
        query.awaitTermination()
