"""Session construction and the shared working folder."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Paths handed out in the open :func:`scratch` blocks of this thread, outermost first.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())


def build_session(app: str = "quillspark", master: str | None = None, **conf) -> SparkSession:
    """A UTC, AQE-enabled session; keyword names use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``, else the one the session's
    owner gave to ``setCheckpointDir``. Where neither is set, a temporary folder is
    made on a local master; on a cluster that is an error, as no folder of one
    machine is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quillspark_dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark._quillspark_dir = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`; inside a :func:`scratch` block it is the block's."""
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    for block in _OPEN.get()[-1:]:
        block.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the
    copy survives lost executors, and every later use costs one scan. It stays until
    the :func:`scratch` block ends in which it is written, if there is one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that are written inside when the block ends, however it ends.

    Write the result inside the block, to a path of your own or with the ``keep(df,
    name)`` that the block gives: that is :func:`materialize` for the block around this
    one. A DataFrame that still reads the block's tables is of no use after it.
    Blocks nest; those of other threads are apart.
    """
    outer, mine = _OPEN.get(), []
    opened = _OPEN.set((*outer, mine))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _OPEN.set(outer)
        try:
            return materialize(df, name)
        finally:
            _OPEN.reset(inside)

    try:
        yield keep
    finally:
        _OPEN.reset(opened)
        for path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
