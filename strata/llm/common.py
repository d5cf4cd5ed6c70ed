"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rows and estimated bytes up to which a small side may be broadcast; beyond either a shuffled join is used.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: What separates words: the ASCII space and the controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. In local mode, as in tests, one is made where none is configured; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = known.get() if known.isDefined() else None
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strata-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, yet keeps column pruning and size
    statistics, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written to the shared folder; call it when no frame made from them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("strata-")] if files.exists(path) else []
    for p in gone:
        files.delete(p, True)
    return len(gone)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint; Spark removes it when the frame is gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit`` and their bytes within ``most_bytes``; else as it is.

    Bytes are the rows times a row's declared width, and what its texts, binaries and arrays
    hold in fact. Call it on stored frames only, as counting is a job of its own.
    """
    fixed = sum(8 for _ in df.schema)
    long = [f"octet_length(`{f.name}`)" for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    long += [f"8 * size(`{f.name}`)" for f in df.schema if f.dataType.typeName() == "array"]
    got = df.agg(F.count("*").alias("n"), F.expr(f"sum({' + '.join(f'coalesce({x}, 0)' for x in long) or '0'})").alias("b")).first()
    return F.broadcast(df) if got["n"] <= limit and got["n"] * fixed + (got["b"] or 0) <= most_bytes else df


#: Parts into which the rows of one key are dealt where a value of their group is attached to them.
SALTS = 256


def attach(df: DataFrame, key: str, spread: str, parts: list[Column], wholes: list[Column]) -> DataFrame:
    """``df`` with values of each row's group (rows of one ``key``); no task gets all rows of a group.

    Rows of a key are dealt into SALTS parts by a hash of ``spread``. ``parts`` are
    aggregates of one part, ``wholes`` aggregates of these; what they give is joined back
    by key and part, so the other side has one row for each part that there is.
    """
    salt, salts = fresh(df, "salt"), fresh(df, "salts")
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("short"))
    total = dealt.groupBy(key, salt).agg(*parts).groupBy(key).agg(*wholes, F.collect_list(salt).alias(salts))
    return dealt.join(total.withColumn(salt, F.explode(salts)).drop(salts), [key, salt]).drop(salt)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with its text as strings, and that column's name: ``text`` itself where it holds strings, so that no task gets each text twice."""
    if any(f.name == "text" and f.dataType == StringType() for f in df.schema):
        return df, "text"
    name = fresh(df, "whole_text")
    return df.withColumn(name, F.col("text").cast("string")), name


#: Rows of an Arrow batch that are Python objects at the same time, and the bytes they hold at most (a longer row stands alone).
SLICE_ROWS = 1024
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most SLICE_ROWS rows and SLICE_BYTES bytes, without a copy."""
    todo = [batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As ``mapInPandas``, but ``run`` gets slices of the Arrow batches, so that a batch of texts is never all Python objects at once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType.fromDDL(schema)
    types = to_arrow_schema(made)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(part.to_pandas() for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_pandas(frame, types, preserve_index=False)

    return df.mapInArrow(each, made)


def per_row(df: DataFrame, inputs: list[str], fields: list[StructField], make: Callable[[], Callable]) -> DataFrame:
    """``df`` with further columns computed from ``inputs``, in Arrow batches and without a shuffle.

    ``make`` is called once a task; what it gives takes lists of the inputs' values
    and returns a list for each of ``fields``. All other columns pass untouched.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = StructType([*df.schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch):
                made = compute(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, t) for x, t in zip(made, types)]], names=[*part.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)
