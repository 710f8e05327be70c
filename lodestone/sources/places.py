"""Where scratch tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent, local masters get a temporary folder that goes at exit; on a cluster
    that is an error, since machines do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        base = _OWN[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
