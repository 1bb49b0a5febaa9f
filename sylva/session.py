"""Session helpers: shipping the package to Python workers and the settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Settings the document operators rely on; all can be set on a running session.
SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


def settled(df: DataFrame, must: bool = False) -> DataFrame:
    """df computed once, in the checkpoint folder that executors share (spark.checkpoint.dir).

    Where it is unset, local mode takes a folder of its own; on a cluster df stays as it is and is computed at each use,
    or (must) it raises, as what follows relies on rows that do not move.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            if must:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            return df
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sylva-checkpoint-"))
    return df.checkpoint()
