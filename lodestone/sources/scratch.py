"""Tables written on the way: in the folder that driver and executors share, reread with a new lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of files up to which Spark may send a written table through the driver.  It takes the packed files for the
#: table's size, and rows as they are sent are many times larger, so its own threshold does not hold for them.
SENT = 1 << 20


class Scratch:
    """Tables of one computation in a folder of their own; `drop` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        """`df` as Parquet, reread: a lost executor costs a reread, and plans stay short."""
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > SENT:
            out = out.hint("merge")
        self.paths[len(self.paths)] = path
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that `write` gave."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df`, written once for what reads it several times."""
    return Scratch(df.sparkSession, label).write(df)
