"""A table in hash buckets of which a merge rewrites only those that the batch touches.

Rows belong to owners (a key, or the file that chunks come from) and lie in the bucket of
their owner's hash.  A merge reads and writes the buckets of the owners that it is given;
all others keep their files.  Which folder holds a bucket now is a snapshot: a small file with
one entry a bucket, published by a rename when the batch's files are whole.  Readers see the
snapshot that is newest; a merge that died has published nothing, and one whose number has
been published changes nothing, so a stream may repeat a batch.

One writer at a time; a second one that publishes the same number gets an error.  Buckets are
fixed when a table is made.  A bucket is written as ``files`` files, dealt by the owner's hash,
so buckets may be large.  The batch is written to the shared folder before it is merged: it is
worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithograph.functions import files as fs
from lithograph.functions.storage import cut
from lithograph.operators.relational import keep_best


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    schema: StructType
    owner: tuple[str, ...]
    buckets: int = 64
    files: int = 1

    def snapshots(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in fs.names(self.spark, f"{self.folder}/snapshots") if n.endswith(".json"))

    def _held(self, number: int | None = None) -> dict[int, str]:
        """Bucket -> folder, of a snapshot or the newest one."""
        known = self.snapshots()
        if number is None and not known:
            return {}
        found = fs.read_json(self.spark, f"{self.folder}/snapshots/{known[-1] if number is None else number}.json")
        if found["buckets"] != self.buckets:
            raise ValueError(f"the table has {found['buckets']} buckets")
        return {int(k): v for k, v in found["folders"].items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a snapshot."""
        return self._read(list(self._held(number).values()))

    def lookup(self, owners: DataFrame) -> DataFrame:
        """Rows of the owners, from their buckets only."""
        held, keys = self._held(), cut(owners.select(*self.owner).distinct())
        return self._read([held[b] for b in self._touched(keys) if b in held]).join(keys, list(self.owner), "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.owner), F.lit(self.buckets)).cast("int")

    def _touched(self, owners: DataFrame) -> list[int]:
        """As many numbers as there are buckets at most."""
        return sorted(r[0] for r in owners.select(self._bucket()).distinct().collect())

    def _publish(self, number: int, touched: list[int], rows: DataFrame, held: dict[int, str]) -> list[int]:
        out = f"{self.folder}/batches/{number}"
        fs.remove(self.spark, out)  # what a merge of this number that died has left
        dealt = rows.withColumn("bucket", self._bucket())
        spread = F.pmod(F.xxhash64(F.lit(1), *self.owner), F.lit(self.files))
        dealt.repartition(max(1, len(touched)) * self.files, "bucket", spread).write.partitionBy("bucket").parquet(out)
        written = {int(n.removeprefix("bucket=")): f"{out}/{n}" for n in fs.names(self.spark, out) if n.startswith("bucket=")}
        now = {b: f for b, f in held.items() if b not in touched} | written
        if not fs.publish_json(self.spark, f"{self.folder}/snapshots/{number}.json", {"buckets": self.buckets, "folders": now}):
            raise RuntimeError(f"another writer has published {number}")
        return touched

    def _start(self, number: int | None) -> int | None:
        """The number of this merge; None where it has been published."""
        known = self.snapshots()
        if number is None:
            return known[-1] + 1 if known else 0
        return None if known and number <= known[-1] else number

    def replace(self, batch: DataFrame, owners: DataFrame, number: int | None = None) -> list[int]:
        """All rows of ``owners`` go, the batch's rows come; the buckets that were rewritten.

        An owner without rows in the batch is removed.  Rows of the batch belong to ``owners``.
        """
        number = self._start(number)
        if number is None:
            return []
        keys, rows = cut(owners.select(*self.owner).distinct()), cut(batch.select(*self.schema.fieldNames()))
        touched, held = self._touched(keys), self._held()
        if not touched:
            fs.publish_json(self.spark, f"{self.folder}/snapshots/{number}.json", {"buckets": self.buckets, "folders": held})
            return []
        same = keys.select(*(F.col(c).alias(f"_{c}") for c in self.owner))
        old = self._read([held[b] for b in touched if b in held])
        on = F.lit(True)
        for c in self.owner:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return self._publish(number, touched, old.join(same, on, "left_anti").unionByName(rows), held)

    def upsert(self, batch: DataFrame, order: list[str], number: int | None = None) -> list[int]:
        """The row of each owner that is last in ``order`` stays, of those held and those that come; the buckets that were rewritten."""
        number = self._start(number)
        if number is None:
            return []
        last = lambda rows: keep_best(rows, list(self.owner), [F.col(c) for c in order], last=True)
        rows = cut(last(batch.select(*self.schema.fieldNames())))
        touched, held = self._touched(rows), self._held()
        if not touched:
            fs.publish_json(self.spark, f"{self.folder}/snapshots/{number}.json", {"buckets": self.buckets, "folders": held})
            return []
        old = self._read([held[b] for b in touched if b in held])
        return self._publish(number, touched, last(old.unionByName(rows)), held)

    def vacuum(self, keep: int = 2) -> None:
        """Remove the snapshots before the last ``keep`` and the folders that only they name."""
        known = self.snapshots()
        kept = {folder for number in known[-keep:] for folder in self._held(number).values()}
        for number in known[:-keep]:
            for folder in set(self._held(number).values()) - kept:
                fs.remove(self.spark, folder)
            fs.remove(self.spark, f"{self.folder}/snapshots/{number}.json")
