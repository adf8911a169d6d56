"""What the operators of this subpackage share: input, shared storage, helper columns and batch-wise Python stages."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark alone, so any path that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared storage -------------------------------------------------------------------------------------------------

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that driver and executors share; it goes when the application ends.

    It lies in spark.checkpoint.dir, or where that is unset in the context's checkpoint folder. With neither, a local
    folder will do for a local master; on a cluster that is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and context._jsc.sc().getCheckpointDir().isDefined():
            base = context._jsc.sc().getCheckpointDir().get()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quillon-shared-')}"
        folder = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
        path, files = _hadoop(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = folder
    return _FOLDERS[app]


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder in here goes at its end: for a caller that has written its result by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows as a Parquet table in the shared folder.

    Later readers don't recompute it, lost executors lose nothing, and the planner knows the size of its files.
    """
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a path that ``new_path`` gave."""
    path, files = _hadoop(spark, where)
    files.delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Delete the tables that ``stored`` wrote for these frames, which nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("rows-"):
                remove(df.sparkSession, folder)


# -- joins that move little -----------------------------------------------------------------------------------------


#: Rows, at most, of a narrow table that is broadcast for a join.
MOST_ROWS = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, with a broadcast hint if these are MOST_ROWS or fewer, else a hint to shuffle and merge.

    Without a hint the planner goes by the size of the files below ``df``, scaled by the columns that are read: it knows
    neither how well they are packed nor how many rows an ``explode`` makes, and a broadcast that it has once chosen stays.
    For joins on equality, whose rows are narrow.
    """
    return F.broadcast(df) if rows <= MOST_ROWS else df.hint("merge")


def small_side(df: DataFrame) -> DataFrame:
    """``df`` as ``sized`` by its rows, which are counted here: broadcast if they are few, else Spark shuffles the join.

    For narrow rows that are stored already, so that counting is cheap.
    """
    return sized(df, df.limit(MOST_ROWS + 1).count())


#: Bits of a marking bitmap, at least and at most (32 MB): the bound of what is broadcast.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


def marked(rows: DataFrame, wanted: DataFrame, *, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with ``maybe``: whether their column ``h`` (a 64-bit hash, not null) may be one of ``wanted``'s (column ``h``, stored).

    False is certain. ``wanted`` becomes a bitmap of 16 bits a row, ``most_bits`` at most, which is broadcast in pages, so
    that only rows that are marked have to be moved for an exact join. With more rows than the bitmap bears, more rows
    are marked in vain, and in the end all.
    """
    n, bits = wanted.count(), LEAST_BITS
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = F.pmod(F.col("h"), F.lit(bits)) + 1
    pages = wanted.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = rows.withColumn("p", at).withColumn("q", F.bitmap_bucket_number("p")).withColumn("p", F.bitmap_bit_position("p"))
    byte = F.conv(F.hex(F.expr("substring(bits, int(p div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(shiftleft(1, int(p % 8)) as int)")
    return held.join(F.broadcast(pages), F.col("q") == F.col("page"), "left").withColumn("maybe", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("p", "q", "page", "bits")


# -- columns --------------------------------------------------------------------------------------------------------


def col(df: DataFrame, name: str) -> Column:
    """A column by its name as it stands, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def nested(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, with the columns ``more`` beside it: so no name can clash."""
    return df.select(F.struct(*[col(df, c) for c in df.columns]).alias("row"), *[x.alias(name) for name, x in more.items()])


def unnested(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns of the struct ``row`` again."""
    return df.select(*[F.col("row")[name].alias(name) for name in names])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of ``df`` (but maps, which Spark doesn't hash), to choose among rows that agree otherwise."""
    return F.xxhash64(F.lit(0), *[col(df, f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


# -- Python stages --------------------------------------------------------------------------------------------------

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of this session hold some 4 MB, not 64: whole texts take several times that in Python.

    The queries and the pipeline call it for their session; operators leave their caller's session alone.
    """
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType, *, carry: Sequence[str] = ()) -> DataFrame:
    """Apply ``fn`` to the columns of each Arrow batch (as Python lists); it returns the output columns, lists or Arrow arrays.

    The columns ``carry`` stay Arrow arrays and pass by; if ``fn`` returns ``None`` as a key, its value says which row
    each output row carries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target, carried = to_arrow_schema(schema), frozenset(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names) if name not in carried})
                rows = out.pop(None, None)
                columns = []
                for f in target:
                    if f.name in carried:
                        columns.append(part.column(f.name) if rows is None else part.column(f.name).take(pa.array(rows, pa.int64())))
                    else:
                        columns.append(x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type))
                yield pa.RecordBatch.from_arrays(columns, names=target.names)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Give memory that a task no longer uses back to the system: workers are kept, and so would be the most they ever took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes, one row at least, so that Python holds few whole texts at once."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, rows * most // max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a code point of a letter category is in the text."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))
