"""Arrow functions on the workers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(df: DataFrame) -> DataFrame:
    """Puts this package on the path of workers that share the driver's machine. On a cluster the package is installed
    or sent with the job (`--py-files`), as any other."""
    paths = df.sparkSession.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths.get("PYTHONPATH")]))
    return df


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: StructType | str) -> DataFrame:
    """mapInArrow on workers that find this package."""
    return reachable(df).mapInArrow(run, schema)
