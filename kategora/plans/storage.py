"""Where intermediate tables live, and how small ones are brought close."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a table may have to be held by the driver and broadcast. Tables asked for here hold one
# row per class, per cut or per histogram bucket, so a row is some hundred bytes at most.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
# Where staged tables lie, so that they can be deleted without asking for their files.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read: the session's ``spark.checkpoint.dir``.

    A temporary folder stands in only where the session is local and names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="kategora-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def staged(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The reader holds 4,096 rows of a file at once; ``rows_per_file`` bounds them where rows are large (0: it does not).

    Cuts the lineage (a lost executor costs a re-read, not a re-run) and gives Catalyst the
    table's true size, from which it picks the join strategy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (weakref.ref(table), path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for table in tables:
        found = _paths.pop(id(table), None)
        if found and found[0]() is table:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A small derived table, ready to be broadcast; staged without a hint when it is not small.

    At most ``limit + 1`` rows are fetched, so rows and bytes are known before anything is broadcast.
    """
    spark = df.sparkSession
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit or table.nbytes > SMALL_BYTES:
        return staged(df, "wide")
    return F.broadcast(spark.createDataFrame(table, schema=df.schema))


def byte_size(schema) -> Column:
    """Column giving the bytes a row of ``schema`` takes, whatever is nested in it by actual length."""
    return sum((_bytes(F.col(f.name), f.dataType) for f in schema.fields), F.lit(16))


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: 8 for its slot, and what lies outside of it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        size = F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0))
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            each = F.aggregate(value, F.lit(0), lambda total, x: (total + _bytes(x, kind.elementType)).cast("int"))
            return 24 + F.coalesce(each, F.lit(0))
        return 24 + 8 * size
    return F.lit(8)
