"""What the operators share: tables cut from their lineage, held-out folds, row keys, components."""

from __future__ import annotations

import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the driver's heap in use from which on stored() has it collected.
IN_USE = 0.3
#: Rows that a function of mapped() gets at once. Spark bounds what it sends by bytes
#: (spark.sql.execution.arrow.maxBytesPerBatch), so long texts come in fewer rows.
BATCH = 1000
#: Keys from which on sieve() builds its filter; the planner broadcasts fewer. Bits a key, at least, and bits in all, at
#: most: beyond 8 MB the filter lets more rows through, which are joined like the others.
FEW, BITS_A_KEY, MOST_BITS = 4096, 16, 1 << 26
#: Of each thread, the tables that its open scratches have stored.
_scopes: dict[int, list[list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset on one machine (a local master, as in tests), a temporary folder is made
    and set. On a cluster that is an error, as executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="siltworks-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as a table of the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    for scope in _scopes.get(threading.get_ident(), [])[-1:]:
        scope.append(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path).alias(path.rsplit("/", 1)[1])


def relieve(spark: SparkSession, in_use: float | None = None) -> bool:
    """Have the driver give back the memory of queries that have ended, if more than a share of its heap is in use.

    An operator runs dozens of queries. Their plans, and with them the shuffles and broadcasts that executors still
    hold, stay until the driver collects its garbage, and what compiling their code took stays with the allocator;
    left alone, both grow up to the driver's limit. Returns whether anything was done.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    share = IN_USE if in_use is None else in_use
    if runtime.totalMemory() - runtime.freeMemory() <= share * runtime.maxMemory():
        return False
    gc.collect()  # what Python holds of the plans
    spark._jvm.java.lang.System.gc()
    with suppress(Py4JError):  # a JVM without this command
        _trim(spark)
    return True


def _trim(spark: SparkSession) -> str:
    """The JVM's command System.trim_native_heap, called by its interface, as the bean's class is not open to Py4J."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    names = "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"
    for k, name in enumerate(names):
        kinds[k] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = bean, "systemTrimNativeHeap"
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at its end, but for those given to the function that it yields.

    That function also takes a table that is yet to be computed and keeps all that it reads. What
    is kept belongs to the scratch around it, if any.
    """
    scopes = _scopes.setdefault(threading.get_ident(), [])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(folder.rsplit("/", 1)[1] for folder in _folders(df))
        return df

    scopes.append([])
    try:
        yield keep
    finally:
        for path in scopes.pop():
            if path.rsplit("/", 1)[1] not in kept:
                _delete(spark, path)
            elif scopes:
                scopes[-1].append(path)


def tidy(operator):
    """operator(rows, ...) without the tables that it stored on the way: only those that its result reads stay."""

    @functools.wraps(operator)
    def run(rows: DataFrame, *args, **options) -> DataFrame:
        with scratch(rows.sparkSession) as keep:
            return keep(operator(rows, *args, **options))

    return run


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltworks/{spark.sparkContext.applicationId}"


def _folders(df: DataFrame) -> set[str]:
    """The folders of the tables that df reads."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application stored, once no result that reads them is needed."""
    _delete(spark, _own_dir(spark))


def drop_stored(df: DataFrame) -> None:
    """Delete a table of stored() that nothing reads any more."""
    for folder in _folders(df):
        _delete(df.sparkSession, folder)


def row_key(*columns: Column | str) -> Column:
    """16 bytes that tell rows apart by the columns' texts; null differs from every text.

    The MD5 of each column's length (-1 for null) and bytes, so no two rows are written alike.
    """
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")
        size = F.coalesce(F.octet_length(value), F.lit(-1)).cast("string")
        parts += [F.concat(size, F.lit(":")).cast("binary"), F.coalesce(value, F.lit(b""))]
    return F.unhex(F.md5(F.concat(*parts)))


def sieve(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame]:
    """rows in two parts: those that surely have none of the keys, and those that may have one.

    Only the second has to be dealt out for a join on the key. Bits by a hash of the keys, sent
    to where the rows are, tell the two apart without a join; of few keys, which are sent
    themselves, all rows are in the second. A null key may be in either.
    """
    n = keys.count()
    if n < FEW:
        return None, rows
    bits = min(MOST_BITS, 1 << (n * BITS_A_KEY - 1).bit_length())
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = keys.select(slot.alias("_slot"))
    maps = at.groupBy(F.shiftright("_slot", 15).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.col("_slot").bitwiseAND(32_767)).alias("_map")
    )
    whole = bytearray(max(bits, 1 << 15) >> 3)
    for bucket, octets in maps.collect():
        whole[bucket << 12 : (bucket + 1) << 12] = octets
    # one value of a local table: a plain literal would be written out in every text of the plan
    table = rows.sparkSession.createDataFrame(pa.table({"_map": pa.array([bytes(whole)], pa.binary())}))
    # the term that may differ by partition keeps the slot a column: the planner would put it into the condition twice,
    # and with it the hash of a text that a key is
    rows = rows.withColumn("_slot", slot + F.lit(0) * F.spark_partition_id())
    octet = F.substring(table.scalar(), F.shiftright("_slot", 3).cast("int") + 1, F.lit(1))
    bit = F.col("_slot").bitwiseAND(7).cast("int")
    bit = F.call_function("shiftright", F.conv(F.hex(octet), 16, 10).cast("int"), bit).bitwiseAND(1)
    return rows.where(bit == 0).drop("_slot"), rows.where(bit == 1).drop("_slot")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is none of the keys; only rows that may go are dealt out."""
    stay, ask = sieve(rows, keys, key)
    left = ask.join(keys, key, "left_anti")
    return stay.union(left.select(*stay.columns)) if stay is not None else left


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """df's columns as one struct _row, beside others: no name of df's can clash with theirs."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *more)


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32(doc_id as text) mod of; a null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % of, F.lit(0)).cast("int")


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema), where function gets at most BATCH rows at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield batch.slice(at, BATCH)

    return df.mapInArrow(lambda batches: function(cut(batches)), schema)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return pc.cast(column, pa.binary()).to_pylist()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), two numbers or two keys, as rows (node, root).

    root is the smallest node of the component. Alternates the large-star and the
    small-star contraction; a node's links are only ever reduced to their minimum and
    joined back on the node, so a centre of many links is never gathered into one row.
    Nodes without edges aren't returned. Ends when a round changes nothing.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.union(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, after
        drop_stored(before)
        last, mark = mark, _mark(now)
        if last == mark:
            break
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count of the edges and a sum of their hashes, which tell whether a round changed them."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
