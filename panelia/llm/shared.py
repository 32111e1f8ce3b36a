"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own where that is unset, which only one machine can share."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def stored(frame: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The rows of ``frame``, written once and read back.

    ``narrow``: rows are few bytes of what their tasks read, and are dealt into files by their own size.
    """
    if narrow:
        frame = frame.hint("rebalance")
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


REST = "rest_of_row"


def pack(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the others as one struct, so that no working column clashes with them."""
    others = [c for c in docs.columns if c not in needed]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    return docs.select(*needed, rest.alias(REST))


def unpack(frame: DataFrame, columns: list[str], needed: tuple[str, ...], *added: Column) -> DataFrame:
    """The columns as they were before ``pack``, and added ones."""
    return frame.select(*(F.col(c) if c in needed else F.col(REST).getField(c).alias(c) for c in columns), *added)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it while it is taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
