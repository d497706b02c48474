"""Session defaults and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kinweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters where it is not installed; Python functions need it there."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="kinweave-")) / "kinweave.zip"  # on the driver; Spark copies it to the executors
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(place))


#: Folders of sessions without a setting, by application. The setting itself cannot be changed once a session runs.
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession | None = None) -> str:
    """The folder that all machines share: of ``spark.checkpoint.dir``; where it is unset a local one if Spark itself is local, else one of the warehouse."""
    spark = spark or SparkSession.active()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc.applicationId not in _folders:
            local = sc.master == "local" or sc.master.startswith("local[")
            _folders[sc.applicationId] = tempfile.mkdtemp(prefix="kinweave-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kinweave"
        folder = _folders[sc.applicationId]
    return folder.rstrip("/")


_open = threading.local()
#: The folder of a scratch table, from a path of one of its files.
_FOLDER = re.compile(r"^(.*?/kinweave-[^/]*-[0-9a-f]{32})(?=/|$)")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/kinweave-{tag}-{uuid.uuid4().hex}"
    for scope in getattr(_open, "scopes", [])[-1:]:
        scope.folders.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """The table written to the shared folder, and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folders(df: DataFrame) -> set[str]:
    """The scratch folders that a plan reads, without their scheme."""
    return {_plain(m[1]) for name in df.inputFiles() if (m := _FOLDER.match(name))}


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that no later plan reads."""
    done: set[str] = set()
    for df in tables:
        for name in df.inputFiles():
            if (m := _FOLDER.match(name)) and m[1] not in done:
                done.add(m[1])
                _delete(df.sparkSession, m[1])


class Scratch:
    """The folders that a block of work wrote; see ``scratch_scope``."""

    def __init__(self) -> None:
        self.folders: list[tuple[SparkSession, str]] = []
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Marks a result: the folders that its plan reads outlive the scope."""
        self._kept.append(df)
        return df

    def close(self, failed: bool) -> list[tuple[SparkSession, str]]:
        """Deletes what no result reads, everything after a failure, and returns what is left."""
        read = set() if failed else set().union(*[scratch_folders(df) for df in self._kept]) if self._kept else set()
        left = []
        for spark, folder in self.folders:
            if _plain(folder) in read:
                left.append((spark, folder))
            else:
                _delete(spark, folder)
        return left


@contextmanager
def scratch_scope():
    """A block whose scratch tables are deleted at its end, but for those that its results still read.

        with scratch_scope() as scratch:
            return scratch.keep(some_operator(...))

    Tables of a result go to the scope around, or stay until ``drop_scratch`` of the result. Only
    tables written by the thread that opened the scope belong to it.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scope, failed = Scratch(), True
    scopes.append(scope)
    try:
        yield scope
        failed = False
    finally:
        scopes.pop()
        left = scope.close(failed)
        if scopes:
            scopes[-1].folders.extend(left)


class Timings:
    """Milliseconds of each step, as a table at the end."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        yield
        self.steps.append((name, (time.perf_counter() - began) * 1000))

    def report(self) -> str:
        rows = [*self.steps, ("Total", sum(ms for _, ms in self.steps))]
        return "\n".join(f"{name:<28}{ms:>12.1f} ms" for name, ms in rows)
