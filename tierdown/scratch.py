"""Shared working storage.

Anything that has to outlive one stage (staged rows, stream checkpoints, lineage
cuts) goes below the folder the cluster names in ``spark.checkpoint.dir``, which
every executor can reach. Only a local session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    # local-cluster[...] runs executors of their own, which need a shared folder too
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tierdown-")
    return _local_roots[context.applicationId]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path nobody else uses; nothing is created until a job writes there."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
