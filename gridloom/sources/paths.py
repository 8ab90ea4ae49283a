"""Rules for object names, and access to them through Hadoop's file systems."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from gridloom.errors import SourceError

REMOTE = ("http", "https", "s3", "s3a", "hdfs", "viewfs", "gs", "abfss")


def redacted(path: str) -> str:
    """The name without user, query or fragment, for messages."""
    return re.sub(r"[?#].*", "", re.sub(r"(?<=://)[^/@]*@", "", path))


def check_object(path: object) -> str:
    """One object: not empty, no glob, a known scheme, no user in the name."""
    if not isinstance(path, str) or not path.strip():
        raise SourceError("invalid_path", "the path must not be empty")
    if re.search(r"[*?\[\]{}]", path):
        raise SourceError("invalid_path", f"globs are not supported: {redacted(path)}")
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", path):
        if m[1].lower() not in (*REMOTE, "file"):
            raise SourceError("invalid_path", f"scheme {m[1]} is not supported")
        if "@" in path.split("://", 1)[1].split("/")[0] or "#" in path:
            raise SourceError("invalid_path", f"user and fragment are not supported: {redacted(path)}")
    return path.rstrip("/") if path != "/" else path


#: Kinds of failure by the simple names of Java exceptions, and by the HTTP status that a service's exception holds.
BY_CLASS = {
    "AccessControlException": "access_denied",
    "AccessDeniedException": "access_denied",
    "AWSClientIOException": "transport",
    "AWSNoResponseException": "transport",
    "AWSServiceThrottledException": "rate_limited",
    "ConnectTimeoutException": "timeout",
    "FileNotFoundException": "object_not_found",
    "HttpTimeoutException": "timeout",
    "InterruptedIOException": "timeout",
    "NoAuthWithAWSException": "configuration",
    "NoAwsCredentialsException": "configuration",
    "NoSuchBucketException": "object_not_found",
    "NoSuchFileException": "object_not_found",
    "NoSuchKeyException": "object_not_found",
    "RangeNotSatisfiableEOFException": "range_request",
    "SocketTimeoutException": "timeout",
    "UnknownStoreException": "object_not_found",
    "UnsupportedFileSystemException": "extension_missing",
}
BY_STATUS = {401: "access_denied", 403: "access_denied", 404: "object_not_found", 408: "timeout", 416: "range_request", 429: "rate_limited", 503: "rate_limited"}


def category_of(chain: list[tuple[str, int | None]]) -> str:
    """The kind of failure, from the (class name, HTTP status) of an exception and of its causes, outermost first."""
    for name, status in chain:
        if status is not None and status >= 400:
            return BY_STATUS.get(status, "http")
        if found := BY_CLASS.get(name.rsplit(".", 1)[-1]):
            return found
    return "transport"


def _classify(error: Exception) -> str:
    """The kind of failure, from the classes of the Java exception and its causes; messages, which hold paths, don't count."""
    java, chain = getattr(error, "java_exception", None), []
    while java is not None and len(chain) < 16:
        kind = java.getClass()
        methods = {m.getName() for m in kind.getMethods() if m.getParameterCount() == 0}
        status = next((getattr(java, m)() for m in ("statusCode", "getStatusCode") if m in methods), None)
        chain.append((kind.getName(), status if isinstance(status, int) else None))
        java = java.getCause()
    return category_of(chain)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the object is there; any doubt is an error, so that only confirmed absence counts as absent."""
    try:
        fs, at = _file_system(spark, path)
        return bool(fs.exists(at))
    except Exception as error:
        raise SourceError(_classify(error), f"{redacted(path)} could not be checked") from error


def version(spark: SparkSession, path: str) -> str:
    """Changes when the object is written anew: sizes and times of its files."""
    fs, at = _file_system(spark, path)
    files = fs.listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name that all executors see: below spark.checkpoint.dir, which is set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("configuration", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
