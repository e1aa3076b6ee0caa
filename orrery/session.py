"""Session helpers: one factory, table access, and fault-tolerant intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "orrery", cpus: str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; a cluster's own session works just as well."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all runs on one machine
    (tests) a temporary folder is made and set; a cluster without the setting is refused, since its
    executors would write to disks that no one else reads.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{checkpoint_root(spark)}/orrery-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str, by: str | None = None, parts: int = 1) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``by``: its rows are dealt to ``parts`` buckets by that column, so that what groups or joins by it later
    needs no shuffle of this table.

    Cuts the lineage: what follows no longer depends on shuffle files or caches of any executor.
    The table stays until ``release`` or ``discard``, since results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        # buckets are known to the catalogue only; the DataFrame keeps them when the name is gone
        name = f"orrery_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", path).bucketBy(parts, by).saveAsTable(name)
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    out._written_path = path
    if _open:
        _open[-1].append(out)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made.  Nothing that is still to be computed may read them."""
    for t in tables:
        _delete(t.sparkSession, t._written_path)


#: Tables made inside each ``intermediate`` block that is open, innermost last.
_open: list[list[DataFrame]] = []


@contextmanager
def intermediate() -> Iterator[Callable[..., None]]:
    """A block whose written tables are deleted at its end, but for those it was told to keep.

    ``with intermediate() as keep: ... keep(table, ...)``: what a lazy result still reads is kept, and
    belongs to the block around this one.  After an error all stay, for whoever looks into it.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _open.pop()
    stay = {t._written_path for t in kept if hasattr(t, "_written_path")}
    release(*[t for t in made if t._written_path not in stay])
    if _open:
        _open[-1].extend(t for t in made if t._written_path in stay)


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are stored."""
    _delete(spark, scratch(spark))
