"""Evidence kept up to date while rows arrive.

Evidence adds up: the pairs that a batch brings are those with older rows and those within the batch. Each batch is written once under its
number, with its own evidence beside it, so that a batch that is run again replaces itself and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import evidence, evidence_added, merge
from ..sources.evidence_files import schema
from ..spec import Attribute, usable


class EvidenceStream:
    def __init__(self, folder: str, attributes: Sequence[Attribute]):
        self.folder, self.attributes = folder.rstrip("/"), usable(attributes)

    def _batches(self, spark: SparkSession, kind: str, before: int | None = None) -> DataFrame | None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return None
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("batch="))
        paths = [f"{self.folder}/{kind}/batch={b}" for b in found if before is None or b < before]
        return spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame, number: int) -> None:
        spark, cols = batch.sparkSession, [a.name for a in self.attributes]
        rows = batch.select(*cols)
        old = self._batches(spark, "rows", number)
        found = evidence(rows, self.attributes) if old is None else evidence_added(old, rows, self.attributes)
        found.write.mode("overwrite").parquet(f"{self.folder}/evidence/batch={number}")
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")

    def current(self, spark: SparkSession) -> DataFrame:
        found = self._batches(spark, "evidence")
        return merge(found, self.attributes) if found is not None else spark.createDataFrame([], schema(self.attributes))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


