"""Session set-up and the places where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan here relies on or profits from; all may be overridden.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "mnemos", **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where driver and executors are one machine's processes ("local", as in tests) may
    it be unset: then a temporary folder is made once per session and recorded there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mnemos-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class _Scopes(threading.local):
    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes, _left = _Scopes(), {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Files that ``cut`` writes inside are deleted at the end; what was derived from them
    has to be written or collected by then. Without a scope they stay until the program ends."""
    _scopes.open.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.open.pop())


def temporary(spark: SparkSession, name: str = "mnemos") -> str:
    """A new path in the shared folder, deleted with the scope it is made in or at the end of the program."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    else:
        if not _left:
            atexit.register(_delete_left)
        _left.setdefault(spark.sparkContext.applicationId, (spark, []))[1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the result survives the loss of any executor."""
    spark = df.sparkSession
    path = temporary(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, text: str) -> bool:
    """Whether a file or folder still exists: others may clear the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


#: Rows up to which ``gathered`` takes a table through the driver.
SMALL_ROWS = 20_000


def gathered(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as the driver holds it, in one partition, so that what follows needs no shuffle; None if it has more rows than ``most``."""
    table = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(table, df.schema).coalesce(1) if table.num_rows <= most else None


def kept(df: DataFrame) -> DataFrame:
    """A table several stages read: through the driver if it is small, else ``cut``."""
    small = gathered(df)
    return cut(df) if small is None else small


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(conf).delete(path, True)


def _delete_left() -> None:
    for spark, paths in _left.values():
        if spark.sparkContext._jsc is not None:  # a stopped session has no file system any more
            with suppress(Exception):
                _delete(spark, paths)


def drop_cut(spark: SparkSession, *cuts: DataFrame) -> None:
    """Delete files that ``cut`` wrote, once nothing reads them any more."""
    _delete(spark, [f.rsplit("/", 1)[0] for df in cuts for f in df.inputFiles()[:1]])
