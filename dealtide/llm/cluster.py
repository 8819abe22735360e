"""Work that outlives executors: written intermediate tables, and shuffle files dropped once they are
used.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_dealtide_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._dealtide_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests in one process, a new temporary one.

    On a cluster a temporary folder is each machine's own, so there it has to be set.
    """
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again: cuts the lineage, survives executors.

    The files stay until the folder is cleared, as those of checkpoint() do by default.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sent(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """Marked for broadcast if it has at most so many rows, which are counted; beyond, the join
    shuffles.

    For stored frames of a few numbers a row.
    """
    return F.broadcast(df) if df.count() <= rows else df


def merged(df: DataFrame) -> DataFrame:
    """Marked so that its join shuffles and sorts, however small Spark takes it to be.

    Spark sizes stored rows as they are compressed and those of an explode or mapInArrow as what goes
    in, and a broadcast so planned stays where sorting would take more shuffles. For frames that grow
    with the input.
    """
    return df.hint("merge")


def tasks(rows: int, each: int) -> int:
    """To coalesce to: a task for `each` rows, and eight at least."""
    return max(8, -(-rows // each))


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files when their action ends, so phases don't pile up on
    disk.
    """
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def phased(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run an operator, whose first argument is a frame, under `releasing`, with the package sent."""

    @wraps(operator)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        ship(first.sparkSession)
        with releasing(first.sparkSession):
            return operator(first, *args, **kwargs)

    return run


def give_back() -> None:
    """Return what this worker has freed to the system: workers are used again, by stages to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: `run`, and before and after it memory that is free goes back."""

    @wraps(run)
    def over(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(rows)
        finally:
            give_back()

    return over


def batches(
    run: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: `run` on slices of bounded bytes of the column `text`."""
    from dealtide.llm import text

    def over(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in text.slices(batch, "text"):
                out = run(part)
                if out is not None and len(out):
                    yield out

    return over
