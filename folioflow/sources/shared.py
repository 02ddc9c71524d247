"""Folders that driver and executors share, for what one query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="folioflow-")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path for a new folder below spark.checkpoint.dir; a folder of its own only for sessions of one process that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or _own_folder(spark.sparkContext.applicationId)).rstrip('/')}/{label}-{uuid.uuid4().hex}"
