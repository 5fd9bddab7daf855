"""Session helpers: tables, shared scratch folders, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_scratch: list[tuple[SparkSession, str]] = []


def build_session(cores: str = "8", app: str = "plexora", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; keyword
    arguments use ``__`` in place of ``.`` in Spark's setting names."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only
    where the session names none (a single-machine session) one is made."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster session must name spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="plexora-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    path = f"{shared_dir(spark)}/plexora-{uuid.uuid4().hex[:12]}-{name}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and
    survives the loss of any executor. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch() -> None:
    """Delete the tables that :func:`materialize` has written so far."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


atexit.register(release_scratch)


def _row_bytes(df: DataFrame) -> int:
    """A row's width by its types; an array counts as 64 values."""
    width = {"string": 48, "binary": 64}
    return 16 + sum(640 if k.startswith(("array", "map", "struct")) else width.get(k, 8) for _, k in df.dtypes)


#: Steps of a plan that are worked out once and written before they are counted.
_COSTLY = ("Aggregate", "Join", "Window", "Distinct", "Deduplicate", "Sort", "Generate", "InPandas", "Intersect", "Except")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and, by their
    width, :data:`BROADCAST_BYTES`. The count stops one row beyond. A larger side
    is returned unmarked: the join is then shuffled, and adaptive execution
    splits skewed partitions. A side that is more than a scan is written first,
    so that it is worked out once and not for the count and again for the join."""
    rows = min(rows, BROADCAST_BYTES // _row_bytes(df))
    plan = df._jdf.queryExecution().analyzed().toString()
    if any(step in plan for step in _COSTLY):
        df = materialize(df, "side")
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df
