"""Session helpers: table access, and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHIPPED: set[str] = set()
WRITTEN: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, in case it isn't installed there."""
    sc, top = spark.sparkContext, Path(__file__).parent
    if sc.applicationId not in SHIPPED:
        SHIPPED.add(sc.applicationId)
        out = Path(tempfile.mkdtemp(prefix="logloom-")) / f"{top.name}-code.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is set in local mode (tests), a local one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="logloom-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts the lineage in a way that outlives executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables that this application has written; results that still read them must be done."""
    for path in WRITTEN.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A folder to another place of the same store; where there is none, an empty one comes to be."""
    store, where = _at(spark, path)
    _, target = _at(spark, to)
    if not store.exists(where):
        store.mkdirs(target)
        return
    store.mkdirs(target.getParent())
    if not store.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark writes to."""
    store, where = _at(spark, path)
    out = store.create(where)
    out.write(bytearray(data))
    out.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it isn't there."""
    store, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where) if x.isDirectory()) if store.exists(where) else []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which clean() removes."""
    path = f"{shared_dir(spark)}/logloom-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def local_session(app: str = "logloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
