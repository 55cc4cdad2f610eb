"""Stores that tasks open by themselves, for files of formats that Spark doesn't read or write."""

from __future__ import annotations

from pyarrow import fs

#: Schemes by pyarrow's names. hdfs and viewfs need libhdfs on the workers.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it; a path without a scheme is a local one."""
    scheme, colon, rest = uri.partition(":")
    if not colon or uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if scheme == "dbfs":  # mounted on the workers
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"tasks can't open {uri}: its scheme has to be one of {', '.join(SCHEMES)} or dbfs")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
