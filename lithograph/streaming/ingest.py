"""Sources that arrive as drops of files, kept as an index of chunks.

A drop is a table of (file_path, content, version): a file as it is at a version, null content
where it is gone.  Deliveries that repeat within ``repeats`` of the drop's time are dropped by
(path, version, hash) in the stream's state; older repeats, and versions that come late, are
told from the index itself.  What is left replaces the chunks of its files, in the buckets of
those files only; a drop that says nothing new writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions.storage import cut
from lithograph.operators import chunking
from lithograph.operators.relational import keep_best
from lithograph.sources import java
from lithograph.sources.keyed import KeyedTable

DROP_SCHEMA = "file_path string, content binary, version long, dropped timestamp"
#: Versions of files, gone ones too, so that a late version of those stays out.
FILE_SCHEMA = "file_path string, content_hash string, version long"


class ChunkIndex:
    """Chunks of files and the versions that they are of, as two keyed tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        kind = chunking.chunk_files(java.parse(spark.createDataFrame([], "file_path string, content binary"))).schema
        self.chunks = KeyedTable(spark, f"{folder}/chunks", kind, ("file_path",), buckets)
        self.files = KeyedTable(spark, f"{folder}/files", spark.createDataFrame([], FILE_SCHEMA).schema, ("file_path",), buckets)

    def news(self, drop: DataFrame) -> DataFrame:
        """Of a drop the last version of each file, where the index has an earlier one with another content, or none."""
        marked = drop.select("file_path", "content", "version", F.coalesce(F.md5("content"), F.lit("")).alias("content_hash"))
        last = cut(keep_best(marked, ["file_path"], [F.col("version"), F.col("content_hash")], last=True))
        held = self.files.lookup(last).select("file_path", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"))
        new = last.join(held, "file_path", "left").where("_version IS NULL OR (version > _version AND content_hash <> _hash)")
        return new.drop("_hash", "_version")

    def take(self, drop: DataFrame, number: int | None = None) -> tuple[list[int], list[int]]:
        """Merge a drop; the buckets of chunks and of files that were rewritten."""
        new = cut(self.news(drop))
        if new.isEmpty():
            return [], []
        texts = java.supported(new.where("content IS NOT NULL")).select("file_path", "content")
        # Chunks first: if the second merge is lost, the repeat finds the file as new and replaces its chunks again.
        chunks = self.chunks.replace(chunking.chunk_files(java.parse(texts)), new.select("file_path"), number)
        files = self.files.replace(new.select("file_path", "content_hash", "version"), new.select("file_path"), number)
        return chunks, files


def ingest(spark: SparkSession, drops: str, folder: str, repeats: str = "7 days", per_batch: int | None = None, buckets: int = 64) -> ChunkIndex:
    """Take every drop below ``drops`` that the stream of ``folder`` has not taken yet."""
    index = ChunkIndex(spark, f"{folder}/index", buckets)
    source = spark.readStream.schema(DROP_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if per_batch:
        source = source.option("maxFilesPerTrigger", per_batch)
    rows = source.parquet(drops).withColumn("mark", F.coalesce(F.md5("content"), F.lit("")))
    once = rows.withWatermark("dropped", repeats).dropDuplicatesWithinWatermark(["file_path", "version", "mark"]).drop("mark")
    query = once.writeStream.foreachBatch(lambda batch, number: index.take(batch, number) and None).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return index
