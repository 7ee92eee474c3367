"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}


def _local(spark: SparkSession) -> bool:
    """Whether driver and workers are one machine's, in one process tree."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing will read again."""
    path = df._written_to
    at = _WRITTEN.pop(path).sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def drop_written() -> None:
    """Delete what is left of :func:`written`, at the end of the driver."""
    for path, spark in list(_WRITTEN.items()):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


_SHIPPED: set[str] = set()


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package: from the driver's folder in local mode, else Spark ships it to them."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if _local(spark):
        env = sc.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), env.get("PYTHONPATH")]))
    elif sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted((root / "tidemark").rglob("*.py")):
                z.write(f, f.relative_to(root))
        path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}.zip"
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
        stream.write(bytearray(packed.getvalue()))
        stream.close()
        _WRITTEN[path] = spark
        sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FORGET: dict[str, Callable[[], None]] = {}


def remembers(who: str, forget: Callable[[], None]) -> None:
    """Say how an operator lets go of what it remembers in a Python worker from task to task."""
    _FORGET[who] = forget


def at_work(who: str) -> None:
    """Begin a task of an operator: a worker that turned to it lets go of what others remember."""
    for other, forget in _FORGET.items():
        if other != who:
            forget()


def text_bytes(spark_col) -> F.Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(spark_col, F.lit("")).cast("binary")


#: A key is hot above this share of all rows; fewer keys than this can be.
HOT_PARTS, SALTS = 1000, 64


def hot_values(rows: DataFrame, key: str) -> list[int]:
    """Values of a long column that more than one row in ``HOT_PARTS`` has: fewer than ``HOT_PARTS``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("_n") > max(64, total // HOT_PARTS))).select(key).collect()]


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """Join of many ``rows`` with ``keyed`` (inner or left), where any key may hold any share of the rows.

    Rows of the first key column's hot values are dealt over ``SALTS`` tasks, to which the few matching rows of ``keyed``
    are copied.
    """
    hot = hot_values(rows, on[0]) if hot is None else hot
    if not hot:
        return rows.join(keyed, on, how)
    is_hot = F.coalesce(F.col(on[0]).isin(hot), F.lit(False))
    salt = F.when(is_hot, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_salt", salt).join(keyed.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge list of longs; root is the smallest node reachable.

    Alternates large-star and small-star rounds (each a map-side aggregated minimum and one join).  A hub's edges meet
    its minimum in one join key, which adaptive execution splits where it is large.  Every round is written to the shared folder.  Self-loops and
    null ends are ignored; no edges give no rows.
    """
    now = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        before_round, now = now, written(large)
        discard(before_round)
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            now.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u > v")
            .distinct()
        )
        before_round, now = now, written(small)
        discard(before_round)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
