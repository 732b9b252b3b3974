"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine (tests) gets a temporary folder; a cluster is refused, since
    its executors would not find the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vitrine-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark then removes a query's shuffle files when it ends; a staged result is read from its own files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends at the latest."""
    path = f"{shared_dir(spark)}/vitrine/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage there.

    A lost executor costs no more than the tasks after this point.  The files are removed by release() or
    when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._vitrine_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Remove the files of results of stage() whose last reader has been written."""
    for df in staged:
        discard(df.sparkSession, df._vitrine_path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path of new_path()."""
    remove(spark, path)
    _STAGED.remove((spark, path))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_staged() -> None:
    """Best effort: a session that has already stopped leaves its folder to the cluster's clean-up."""
    for spark, path in _STAGED:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001
            return


_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as --py-files would.

    Rows here hold whole texts, so the session's Arrow batches have 1000 rows from then on, unless their size was set.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, "1000")
    if spark.sparkContext.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="vitrine-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/vitrine_package", "zip", root, "vitrine"))
        _SHIPPED.add(spark.sparkContext.applicationId)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    schema: list[tuple[str, str, pa.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 512,
) -> DataFrame:
    """Apply a per-batch function to every text; id_col is carried along unchanged.

    A batch has at most `rows` texts, which bounds the memory of a task.  make() is called once per task and returns a function from a batch of texts to lists by column name.
    schema: (name, Spark type, Arrow type) of the columns that it makes, as lists or Arrow arrays.
    """
    ship(docs.sparkSession)
    src = docs.select(id_col, text_col)
    kind = dict(src.dtypes)[id_col]
    ddl = ", ".join([f"`{id_col}` {kind}", *(f"`{n}` {t}" for n, t, _ in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            got = fn(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(x if isinstance(x := got[n], pa.Array) else pa.array(x, t) for n, _, t in schema)],
                names=[id_col, *(n for n, _, _ in schema)],
            )

    return src.mapInArrow(run, ddl)


def packed(rows: DataFrame, text_col: str = "_text") -> DataFrame:
    """rows with the text compressed, for a shuffle that carries whole texts; unpack() undoes it in the task that reads it."""
    at = rows.columns.index(text_col)
    ddl = ", ".join(f"`{n}` {'binary' if n == text_col else t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in batch.column(at).to_pylist()]
            cols = [pa.array(small, pa.binary()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return rows.mapInArrow(run, ddl)


def unpack(texts: list[bytes | None]) -> list[str | None]:
    open_up = zstandard.ZstdDecompressor()
    return [None if t is None else open_up.decompress(t).decode("utf-8") for t in texts]


class BoundedCache(dict):
    """A word cache of at most `most` entries; when it is full, the half that came first goes."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def room(self, extra: int) -> None:
        if len(self) + extra > self.most:
            for key in list(islice(self, (len(self) + 1) // 2)):
                del self[key]
