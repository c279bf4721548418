"""Cutting lineage through files that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a session on one machine, as in tests, takes a temporary one; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or os.path.join(tempfile.gettempdir(), "quarry-checkpoints")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be met by a shuffle whatever its size. A broadcast is chosen by the compressed size of what was shuffled and goes through the driver; in an iteration, once a round."""
    return df.hint("merge")


class Rounds:
    """Tables of an iteration, written to the shared folder. A name holds its latest version only; done() removes all of them.

    A checkpoint keeps the estimated size of the plan it cuts, which a round of self-joins squares; a table that is read again has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", {}, 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{name}-{self.n}", self.n + 1
        df.write.parquet(path)
        if name in self.paths:
            remove(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self) -> None:
        remove(self.spark, self.folder)

    def leave(self, *names: str) -> None:
        """Remove these tables; the others, which a result still reads, stay until the session ends."""
        for name in names:
            remove(self.spark, self.paths.pop(name))
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the shared one, once its rows have been read or copied."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
