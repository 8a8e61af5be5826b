"""Tables written to the folder that all executors see, so that plans end there and lost executors cost nothing before them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of this session's own if Spark runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chartwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes rows and reads them back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = FEW) -> DataFrame:
    """A join with a written table, by broadcast up to `most` rows of it; beyond, by a shuffle whose skewed partitions adaptive execution splits."""
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)
