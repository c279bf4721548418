"""Helpers shared by the corpus operators: tables, checkpoints, small joins, packed integers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.lineage import checkpoint, shared_dir

__all__ = ["checkpoint", "fields", "free_names", "join_lookup", "pack", "partitions", "salted_join", "shared_dir", "table", "unpack"]

#: Most rows and bytes of a lookup table that may be broadcast; a larger one is joined by a salted shuffle.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 20_000, 32 << 20
#: Tasks that one key of a larger lookup table is dealt to.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_lookup(df: DataFrame, lookup: DataFrame, on, salt: F.Column, how: str = "left", max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join a checkpointed lookup table: broadcast if it has at most max_rows rows and max_bytes bytes, else by a shuffle.

    That shuffle deals the rows of one key to SALTS tasks by `salt`, a hash of a row. Rows and bytes are counted over max_rows + 1 rows at
    most, so that it stays cheap for a large lookup.
    """
    rows, size = lookup.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*lookup.columns)))), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return df.join(F.broadcast(lookup), on, how)
    return salted_join(df, lookup, on, salt, how)


def salted_join(left: DataFrame, right: DataFrame, on: F.Column, salt: F.Column, how: str = "left") -> DataFrame:
    """An equi-join that deals the left rows of one key to SALTS tasks by `salt`, a hash of a left row, and every right row to all of them."""
    (mine,) = free_names(left, "salt_")
    (theirs,) = free_names(right, f"{mine}of_right_")
    one = left.withColumn(mine, F.pmod(salt, F.lit(SALTS)).cast("int"))
    two = right.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return one.join(two, on & (one[mine] == two[theirs]), how).drop(mine, theirs)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes of their differences: what Spark's shuffle compression shrinks best."""
    v = np.asarray(values, dtype=np.int64)
    if not len(v):
        return b""
    d = np.diff(v, prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    planes = max(1, (int(z.max()).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(z).view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + raw.T.tobytes()


def unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    planes = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    z = out.reshape(-1).view(np.uint64)
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    return np.cumsum(d)


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields
