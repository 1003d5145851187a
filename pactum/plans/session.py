"""Session settings, table readers and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int = 8, partitions: int = 8, app: str = "pactum", memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine is tested with; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def all_columns(df: DataFrame) -> list[Column]:
    """Every column of ``df``, whatever characters its name holds."""
    return [F.col(quoted(c)) for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a new
    folder; a cluster has no machine-local folder that all its nodes see, so it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The scopes that are open in this thread or task: another one's tables are not deleted with them.
_open_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())
_cleanup_lock = threading.Lock()
_cleaning: dict[int, list] = {}


@contextmanager
def _shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Drop shuffle files once a query has ended, until the last of the writes that ask for it at a time is over."""
    with _cleanup_lock:
        state = _cleaning.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(SHUFFLE_CLEANUP, "false")
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _cleanup_lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(SHUFFLE_CLEANUP, state[1])
                del _cleaning[id(spark)]


def materialize(df: DataFrame, name: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, partitioned ``by`` columns, and read it back.

    The lineage is cut there, and losing an executor costs no more than the tasks it was running. The shuffle files of
    the write are dropped once it has ended, since nothing can ask for them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffle_cleanup(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for paths in _open_scratch.get():
        paths.append(path)
    return out


def _store(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the store that holds ``path``."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    store, target = _store(spark, path)
    store.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return store.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    store, target = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(target)] if store.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, target = _store(spark, path)
    stream = store.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place whole. False if there is one already: the rename does not overwrite."""
    store, target = _store(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    store.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{target.getName()}.{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError as refused:
        store.delete(draft, False)
        if "FileAlreadyExists" in str(refused.java_exception):
            return False
        raise


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` returned, once nothing will read them again."""
    for df in frames:
        delete_path(df.sparkSession, df.scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete everything that is materialized inside, at the end: for callers that write their result inside, too.
    Paths taken out of the list are kept."""
    paths: list[str] = []
    outer = _open_scratch.set((*_open_scratch.get(), paths))
    try:
        yield paths
    finally:
        _open_scratch.reset(outer)
        for path in paths:
            delete_path(spark, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they can import it wherever they run."""
    import shutil

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stem = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pactum_package")
    context.addPyFile(shutil.make_archive(stem, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(context.applicationId)


#: Rows of text are wide: a batch of Spark's 10,000 would hold tens of megabytes on both sides of the worker's pipe.
ARROW_ROWS = "2000"
ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def for_workers(spark: SparkSession) -> None:
    """Send the package to Python workers, and let batches hold ``ARROW_ROWS`` rows unless the session says otherwise."""
    ship_package(spark)
    if spark.conf.get(ARROW_BATCH) == "10000":
        spark.conf.set(ARROW_BATCH, ARROW_ROWS)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    for_workers(df.sparkSession)
    return df.mapInArrow(function, schema)
