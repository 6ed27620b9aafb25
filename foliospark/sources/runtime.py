"""Session helpers: shipping the package to executors, shared scratch tables, Arrow batch size."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python. Rows carry whole texts or files, so batches stay short.
ARROW_ROWS = 512

_shipped: dict[str, str] = {}
_loaders: dict[tuple[str, str], JavaObject] = {}
_scratch: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and shorten Arrow batches.

    Python workers then import it whatever their path is.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent.parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f"{root.name}/{f.relative_to(root)}")
        at = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
        Path(at).write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(at)
        _shipped[app] = at
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def java_object(spark: SparkSession, source: Path, name: str) -> JavaObject:
    """A new object of the class so named of a Java file, which Spark's own compiler compiles once per application; the
    executors get it as a jar."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    key = spark.sparkContext.applicationId, name
    if key not in _loaders:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source.read_text())
        at = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), f"{name}-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
            for x, code in compiler.getBytecodes().items():
                out.writestr(x.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(at)
        _loaders[key] = compiler.getClassLoader()
    return _loaders[key].loadClass(name).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="foliospark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of whatever file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str, tag: str = "") -> str:
    """A new path under the shared folder. tag: what drop_scratch() goes by."""
    path = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_at_exit)
    _scratch.setdefault(tag, []).append(path)
    return path


def table(df: DataFrame, name: str, tag: str = "", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, tag: str) -> None:
    """Delete the scratch tables made under a tag; only when what reads them has been written elsewhere."""
    for path in _scratch.pop(tag, []):
        remove(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for tag in list(_scratch):
            try:
                drop_scratch(spark, tag)
            except Exception:  # noqa: BLE001  the gateway may be gone already
                return


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's bytes: of the files for a scan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
