"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or by setCheckpointDir. Without one there is no place that all executors see, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        # One process: driver and executor see the same disk.
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def free_name(columns: list[str], name: str) -> str:
    """`name`, with underscores behind until no column has it (letters' case doesn't tell names apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


class Scratch:
    """Writes tables as Parquet in the shared folder and reads them again, which cuts their lineage. Holds broadcasts to be freed with them.

    From the first one on, the session's Arrow batches are of 4 MB at most, which bounds the memory of Python workers and of the buffers
    on the way to them, also where a caller writes an operator's result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self.shared: list[Broadcast] = []
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))

    def share(self, value) -> Broadcast:
        """A broadcast that `free` ends."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def free(self) -> None:
        """Ends the broadcasts made so far: only after all that reads them has been written."""
        for b in self.shared:
            b.destroy()
        self.shared.clear()
        gc.collect()

    def keep(self, df: DataFrame) -> DataFrame:
        """The written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(kept)))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
