"""Session helpers: tables cut from their lineage, size-checked broadcasts, bounded segments."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Rows, and bytes of texts and arrays, up to which a side may be broadcast; checked by counting, never assumed.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so it need not be installed where they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lithocube-")
    atexit.register(shutil.rmtree, folder, True)
    to = Path(folder) / "lithocube.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: `spark.checkpoint.dir` of the session, own only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lithocube-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    It cuts lineage as checkpoint() does, survives lost executors, and keeps column pruning. The folder goes when the
    JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lithocube/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, and its texts and arrays at most `bytes_` bytes, else as
    it is (the join then shuffles)."""
    wide = [f for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType))]
    size = F.lit(0).cast("long")
    for f in wide:
        text = F.col(f"`{f.name}`") if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(f"`{f.name}`"))
        size = size + F.coalesce(F.octet_length(text).cast("long"), F.lit(0))
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= bytes_ else df


def settings(df: DataFrame, rows: int = 1_000) -> list[Row]:
    """The rows of a small table of settings; more than `rows` are an error, never cut off."""
    got = df.take(rows + 1)
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows of settings")
    return got


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
