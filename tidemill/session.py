"""Session helpers."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Settings under which Python workers give memory back to the system between batches.
WORKER_ENVIRONMENT = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}
#: Sizes of the batches that go to a Python worker: Spark's own default, too large where rows are texts, and
#: what takes its place where the session has no figure of its own.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b"),
}


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local or shared-folder deployment import this package, in bounded memory.

    On other clusters the package is passed with ``--py-files`` as usual.
    """
    for name, value in WORKER_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, (default, smaller) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, smaller)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder of ``spark.checkpoint.dir``, its lineage cut, for plans that read it several times.

    Where that is unset, a temporary folder is made if the session runs in one process, as in tests; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidemill-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
