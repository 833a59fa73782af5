"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, unless they find it on PYTHONPATH."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    listed = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(root.parent) in listed:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="tidalframe-")) / "tidalframe.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def computed_once(df: DataFrame) -> DataFrame:
    """df cut from its inputs, so that many jobs over it don't each read them again: in the folder that spark.checkpoint.dir names, else in the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
