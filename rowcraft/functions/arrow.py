"""Arrow batches through Python, where no built-in expression will do."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers also look for this package where it is here.

    On a cluster that installs the package, or gets it with ``--py-files``, the
    added search path changes nothing.
    """
    workers, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in (workers.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(run, schema)
