"""Helpers the operators share: typed inputs, Arrow-batched text work, staging."""

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_root, configure

#: Rows turned into Python objects at once, whatever the size of an Arrow batch.
SLICE = 128
#: A result batch ends at so many rows or bytes.
OUT_ROWS, OUT_BYTES = 2048, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound Arrow batches, so that long texts fit a worker."""
    configure(spark)
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(name, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; others, whatever their names, are left behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def staged(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    Cuts lineage so that a lost executor costs a re-read; see ``checkpoint_root``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{what}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no result reads any more."""
    spark = df.sparkSession
    for uri in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _values(batch: pa.Array) -> Iterator:
    for at in range(0, len(batch), SLICE):
        yield from batch.slice(at, SLICE).to_pylist()


def _struct(rows: list[tuple], schema: pa.Schema) -> pa.StructArray:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrays = [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(schema))


def text_udf(schema: str, make: Callable[[], Callable[[str | None], tuple]]):
    """An Arrow UDF of one text column; ``make`` builds a worker's function once per task.

    Marked non-deterministic so that a filter on its result never runs it twice.
    """
    types = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work, fields = make(), to_arrow_schema(types)
        for batch in batches:
            yield _struct([work(x) for x in _values(batch)], fields)

    return F.arrow_udf(run, types).asNondeterministic()


def annotate(df: DataFrame, udf: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """(doc_id, fields of the UDF's struct), one row per row; nothing is shuffled."""
    kept = columns(df, doc_id="long", **{text: "string"})
    return kept.select("doc_id", udf(F.col(text)).alias("found")).select("doc_id", "found.*")


def decide(df: DataFrame, udf: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """The rows, all columns as they are, for which ``keep(struct)`` holds."""
    mark = free_name(df, "found")
    return df.withColumn(mark, udf(F.col("`text`").cast("string"))).filter(keep(F.col(mark))).drop(mark)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` over each partition's rows as a stream of tuples, in bounded batches."""
    types = T.StructType.fromDDL(schema)

    def run(batches):
        fields = to_arrow_schema(types)

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: list[tuple] = []
        size = 0
        for row in work(rows()):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield pa.RecordBatch.from_struct_array(_struct(out, fields))
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_struct_array(_struct(out, fields))

    return df.mapInArrow(run, types)


_KEPT: dict[tuple, object] = {}


def worker_cache(build: Callable):
    """Keep what a worker builds from a broadcast between its tasks, until it builds anything else.

    Workers are reused by later stages and by other operators; what they no longer
    need must not take the memory of what they do.
    """

    @functools.wraps(build)
    def kept(*args):
        key = (build.__module__, build.__qualname__, args)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = build(*args)
        return _KEPT[key]

    return kept


ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
