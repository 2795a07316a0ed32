"""Shared scratch space: the one folder that driver and executors of a cluster have in common."""

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) a temporary one of this machine, which becomes the checkpoint folder too."""
    root = spark.conf.get(KEY, None)
    if not root:
        root = getattr(shared_root, "own", None)
        if root is None:
            root = shared_root.own = "file://" + tempfile.mkdtemp(prefix="turfspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), unquote(urlparse(uri).path) if uri.startswith("file:") else uri
