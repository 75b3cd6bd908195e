"""Tables that are computed once and read again, in the shared folder of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, run and written in the folder of ``spark.checkpoint.dir``; in a temporary one where that is unset and all runs in one process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="harrow-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
        context.setCheckpointDir(root)
    return df.checkpoint()
