"""Shared helpers of the training-data operators."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the
    setting is absent a local session gets a folder of its own; a cluster has
    to name one, as executors do not share their machines' folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for what runs inside the block; other queries of the same session see it meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Smaller Arrow batches, for Python steps that hold several arrays a text."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables of one operator's run, in the shared folder.

    keep() cuts lineage: it writes a Parquet table and gives back a frame that
    reads it, so a lost executor costs no more than the step at hand. The write's
    own shuffle files go when it has ended. drop() deletes tables that nothing
    reads any more, close() all of them but those named."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/lodeweave/{label}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str, replace: bool = False, **options) -> DataFrame:
        """df as a table, written with options; with replace, earlier tables of the name are deleted once this one is written."""
        earlier = list(self.made.setdefault(name, []))
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:12]}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.options(**options).parquet(path)
        self.made[name].append(path)
        if replace:
            self._remove(earlier)
            self.made[name] = [path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.made.pop(name, []))

    def close(self, *kept: str) -> None:
        self.drop(*[n for n in self.made if n not in kept])

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder that stays; see Scratch."""
    return Scratch(df.sparkSession, label).keep(df, "table")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, so that extra columns never clash."""
    names, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in names:
        name += "_"
    return name


#: Bits of the filter below: at most FILTER / 64 rows are broadcast, whatever the number of rows.
FILTER = 1 << 22


def may_be_among(docs: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """docs with a boolean: false only where key is certainly not among ids (key). The filter has a fixed size and is broadcast."""
    h, word, bits = (fresh(docs, x) for x in ("h", "word", "bits"))
    bit = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FILTER))
    table = ids.select(bit.alias(h)).groupBy(F.floor(F.col(h) / 64).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({h} % 64 as int))")).alias(bits))
    x = docs.withColumn(h, bit).withColumn(word, F.floor(F.col(h) / 64)).join(F.broadcast(table), word, "left")
    return x.withColumn(name, F.coalesce(F.expr(f"(shiftrightunsigned({bits}, cast({h} % 64 as int)) & 1L) = 1L"), F.lit(False))).drop(h, word, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, longest: int = 1 << 17) -> DataFrame:
    """At most per_class labelled training documents of either class, the
    smallest by a hash of doc_id: (doc_id, text, y). The id list is bounded by
    2 * per_class, so it is broadcast whatever the size of the corpus. A doc_id
    that stands in several rows counts once, with its smallest text; texts of
    more than longest characters are not learned from, so the sample has at most
    2 * per_class * longest characters."""
    lab = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & train)
    lab = lab.groupBy("k").agg(F.max("y").alias("y"))
    ids = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    return some.join(F.broadcast(ids), F.col("doc_id") == F.col("k")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def stored(df: DataFrame) -> bool:
    """Whether df is read from files and nothing else, so that every row has a place there that stays."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "SubqueryAlias":
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and len(df.inputFiles()) > 0


def placed(df: DataFrame, part: str, at: str) -> DataFrame:
    """df, read from files, with each row's place: a hash of its file, and its number there."""
    meta = df.metadataColumn("_metadata")
    return df.withColumns({part: F.xxhash64(meta["file_path"]), at: meta["row_index"]})


#: Rows of a table up to which it is broadcast to a join; a larger one is shuffled.
FEW = 1 << 16


def repeats(rows: DataFrame, key: str, place: list[str], above: int = 1, per_task: int = 2000) -> DataFrame | None:
    """(*place, key, copy): the rows of every key (a long) that more than ``above`` rows have, numbered from 0; None without such keys. place tells any two rows apart.

    A key's rows are dealt by their places into parts of about per_task, each numbered on its own; the parts' counts, a
    small table, give the offsets. So a key may have any share of all rows."""
    m, s, before = (fresh(rows, x) for x in ("m", "s", "before"))
    keys = durable(rows.groupBy(key).agg(F.count("*").alias(m)).where(F.col(m) > above), "repeats")
    if keys.isEmpty():
        return None
    hot = rows.select(*place, key).join(F.broadcast(keys) if keys.count() <= FEW else keys, key)
    hot = durable(hot.select(*place, key, F.pmod(F.xxhash64(F.lit(1), *place), F.ceil(F.col(m) / per_task)).alias(s)), "repeats")
    counts = hot.groupBy(key, s).agg(F.count("*").alias(m))
    offsets = counts.select(key, s, (F.sum(m).over(Window.partitionBy(key).orderBy(s)) - F.col(m)).alias(before))
    n = F.row_number().over(Window.partitionBy(key, s).orderBy(*place)) - 1
    return hot.withColumn(m, n.cast("long")).join(offsets, [key, s]).select(*place, key, (F.col(m) + F.col(before)).alias("copy"))


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def row_type(**fields) -> T.StructType:
    """A struct type from names of simple types (or types); unlike DDL text it needs no session at import."""
    return T.StructType([T.StructField(k, _TYPES.get(v, v) if isinstance(v, str) else v) for k, v in fields.items()])


def list_of(kind) -> T.ArrayType:
    return T.ArrayType(_TYPES[kind] if isinstance(kind, str) else kind)


def slices(series, limit: int):
    """Lists of texts of about ``limit`` characters, a longer text alone."""
    some, held = [], 0
    for t in series:
        some.append(t)
        held += len(t) if t else 0
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some
