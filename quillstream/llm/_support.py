"""Shared plumbing: table access, intermediate tables in the shared folder, code shipping."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch when whole texts go to Python: bounds what one worker holds at a time.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(df: DataFrame, column: str) -> Column:
    """A column of df by its whole name, dots and backticks included."""
    return df["`" + column.replace("`", "``") + "`"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings changed for a while; underscores stand for dots."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Characters of a plan's description that the driver keeps for each job; long expressions would fill its memory.
PLAN_CHARS = "20000"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with setting(spark, spark_sql_maxPlanStringLength=PLAN_CHARS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of what finished plans hold: Spark drops shuffles and broadcasts only when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Share of the driver's largest heap beyond which the heap is collected and given back between two plans.
GROWN = 0.5


def tidy_if_grown(spark: SparkSession) -> None:
    """Tidy once the heap has grown: planning leaves garbage, for which the heap would rather grow than be collected."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > GROWN * runtime.maxMemory():
        tidy(spark)


#: Bits of a key filter, in bitmaps of 32,768: at most 2 MB, whatever the number of keys. More bits pay off above ten million keys.
FILTER_BITS = 1 << 24


def _spot(key: Column) -> tuple[Column, Column]:
    """Bitmap and position in it of a long key."""
    spot = F.pmod(F.xxhash64(key.cast("long")), F.lit(FILTER_BITS))
    return F.shiftright(spot, 15), spot.bitwiseAND(32767)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(__bucket, __bits): a bitmap of the hashes of a column of longs, for may_be_in."""
    bucket, position = _spot(F.col(key))
    return keys.where(F.col(key).isNotNull()).groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(position).alias("__bits"))


def may_be_in(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """df with a boolean __may: false only where key is surely not among the filter's keys.

    The broadcast is bounded by FILTER_BITS. More keys than bits make the flag true more often, never wrong,
    so that what follows has to move more rows. A null key gives false.
    """
    bucket, position = _spot(key)
    met = df.withColumn("__at", bucket).join(F.broadcast(bits), F.col("__at") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, position.bitwiseAND(7).cast("int"))
    return met.withColumn("__may", F.coalesce(key.isNotNull() & (bit == 1), F.lit(False))).drop("__at", "__bucket", "__bits")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors (once per session) and bound Arrow batches of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_quillstream_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quillstream-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillstream_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for where, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    context._quillstream_shipped = True


def bind(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a lambda variable.

    A column that a lambda mentions is evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of longs, in linear time for all practical lengths.

    Sums inside blocks are taken directly; block totals are summed by one fold, so no array is
    copied once per element.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def with_lengths(ls: Column) -> Column:
        blocks = F.when(F.size(ls) == 0, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / block).cast("int"))
        )
        sums = F.transform(blocks, lambda b: total(F.slice(ls, b * block + 1, F.lit(block))))
        starts = F.aggregate(
            sums,
            F.array(F.lit(0).cast("long")),
            lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)),
        )
        return bind(
            starts,
            lambda st: F.transform(
                ls,
                lambda _, i: F.get(st, F.floor(i / block).cast("int"))
                + total(F.slice(ls, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        )

    return bind(lengths, with_lengths)


def running_most(values: Column, block: int = 64) -> Column:
    """For each of an array of longs the greatest of those before it (the first: -2 ** 62), in blocks like prefix_sums."""
    least = F.lit(-(1 << 62)).cast("long")

    def most(part: Column) -> Column:
        return F.aggregate(part, least, lambda a, x: F.greatest(a, x))

    def with_values(vs: Column) -> Column:
        blocks = F.when(F.size(vs) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / block).cast("int")))
        each = F.transform(blocks, lambda b: most(F.slice(vs, b * block + 1, F.lit(block))))
        starts = F.aggregate(each, F.array(least), lambda acc, m: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), m))))
        return bind(
            starts,
            lambda st: F.transform(
                vs,
                lambda _, i: F.greatest(
                    F.get(st, F.floor(i / block).cast("int")), most(F.slice(vs, F.floor(i / block).cast("int") * block + 1, i % block))
                ),
            ),
        )

    return bind(values, with_values)


def cut_at(text: Column, spans: Column, block: int = 256) -> Column:
    """array of the texts of spans (start, end), which ascend without overlaps.

    The text is cut into the reaches of blocks of spans first, so that no piece is sought from the start of a long text.
    """

    def cut(of: Column, start: Column, end: Column) -> Column:
        return F.substring(of, (start + 1).cast("int"), (end - start).cast("int"))

    def with_spans(s: Column) -> Column:
        def of_block(own: Column) -> Column:
            base = F.get(own, F.lit(0))["start"]
            return bind(
                cut(text, base, F.element_at(own, -1)["end"]),
                lambda t: F.transform(own, lambda x: cut(t, x["start"] - base, x["end"] - base)),
            )

        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        each = F.transform(blocks, lambda b: bind(F.slice(s, b * block + 1, F.lit(block)), of_block))
        return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(F.flatten(each))

    return bind(spans, with_spans)
