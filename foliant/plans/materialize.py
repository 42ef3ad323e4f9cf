"""Cutting lineage where several branches of a plan read the same relation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """Write ``rows`` once to the shared checkpoint folder and read them from there.

    The folder is the one in ``spark.checkpoint.dir``. Where none is named, a run on this machine alone (tests) gets
    a temporary one; on a cluster that is an error.
    """
    sc = rows.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return rows.checkpoint(eager=True)
