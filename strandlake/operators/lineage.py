"""Durable cuts of the lineage for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors share.

    A folder of our own is used only where ``spark.checkpoint.dir`` is unset, as in local tests.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandlake-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the session names and go on from the written rows."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


#: A narrow table that is counted and found shorter than this is broadcast.
BROADCAST_ROWS = 1 << 17


def short(rows: DataFrame, weight: Column | None = None) -> bool:
    """Whether a table that is written already has BROADCAST_ROWS rows at most, and ``weight`` of them (say, sizes of lists) adds up to eight times that at most."""
    if rows.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    return weight is None or (rows.agg(F.sum(weight)).first()[0] or 0) <= 8 * BROADCAST_ROWS


def few(rows: DataFrame) -> DataFrame:
    """A narrow table, written, and marked for a broadcast if it is counted and found short; a longer one is shuffled."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
