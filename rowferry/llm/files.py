"""Binary files in the shared folder, written and read by range inside tasks."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from rowferry.plans.session import scratch_path


def shared_uri(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder, with its scheme resolved on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", qualified)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def fresh_name(folder: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: only files in the manifest count."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def opened(uri: str):
    """For reading at any place."""
    system, path = located(uri)
    return system.open_input_file(path)
