"""Helpers shared by the operators of this subpackage: shared storage, tables and fixed patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage: space and \t \n \v \f \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
HELD_OUT_FOLDS = 5


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Arrow batches (whose bytes Spark bounds by ``spark.sql.execution.arrow.maxBytesPerBatch``) in
    slices of at most ``rows`` rows, so that no more texts than those are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (``spark.checkpoint.dir``).

    Only where that setting is absent (a single machine, as in tests) a local temporary folder is
    taken instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/gridloom-shared"
    return f"{root.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def written(spark: SparkSession, frame: DataFrame, folder: str | None = None, name: str = "t") -> DataFrame:
    """Write a frame as Parquet to shared storage and read it back: a cut of lineage that outlives
    any executor."""
    path = f"{folder or shared_dir(spark)}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_session(spark: SparkSession) -> SparkSession:
    """A session of an operator's own steps, beside the user's: Spark deletes a step's shuffle files when
    the step ends, and no setting of the user's session changes."""
    own = spark.newSession()
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def merged_labels(spark, folder: str, name: str, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (doc, comp) after joining the components at both ends of each edge (a, b). Each label is
    the smallest document of its component if it was before."""
    step = 0
    while True:
        ends = edges.join(labels.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(
            labels.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
        both = ends.select(F.col("ca").alias("u"), F.col("cb").alias("v")).unionByName(ends.select(F.col("cb").alias("u"), F.col("ca").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
        up = written(spark, up, folder, f"{name}-up{step}")
        if up.isEmpty():
            return labels
        jump = 0
        while True:  # let every component point at the end of its chain
            over = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
            up = written(spark, up.select("u", "v").join(over, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("w") != F.col("v")).alias("moved")), folder, f"{name}-up{step}-{jump}")
            if up.where("moved").isEmpty():
                break
            jump += 1
        up = up.select(F.col("u").alias("comp"), "v")
        labels = written(spark, labels.join(up, "comp", "left").select("doc", F.coalesce("v", "comp").alias("comp")), folder, f"{name}-labels{step}")
        step += 1


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that ``frame`` does not have: those given, with underscores
    in front where they are taken."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo ``HELD_OUT_FOLDS``; 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold. Columns: key, text, label.

    The first ``rows`` labelled ids by a hash of the id are chosen from the labels alone, so any order of
    the input gives the same sample; of their documents those of at most ``max_chars`` characters are
    taken, again ``rows`` at most. Rows with a null id, label or text take no part; an id with several
    labels takes the smallest. The chosen ids are at most ``rows``, so they are broadcast and no text is
    shuffled."""
    marked = (labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label"))
              .where("key is not null and label is not null").groupBy("key").agg(F.min("label").alias("label")))
    chosen = marked.where(fold("key") != 0).orderBy(F.xxhash64("key"), "key").limit(rows)
    known = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return known.join(F.broadcast(chosen), "key").orderBy(F.xxhash64("key"), "key", "text").limit(rows)


class Known(dict):
    """Values of keys, worked out when they are first asked for; emptied when it holds ``limit`` keys, or
    ``chars`` characters (or bytes) of keys."""

    def __init__(self, made, limit: int, chars: int = 16_000_000):
        super().__init__()
        self.made, self.limit, self.chars, self.held = made, limit, chars, 0

    def __missing__(self, key):
        if len(self) >= self.limit or self.held > self.chars:
            self.clear()
            self.held = 0
        self.held += len(key)
        value = self[key] = self.made(key)
        return value


class Recent:
    """A bounded memory of what has been worked out: when ``young`` holds ``limit`` entries, or keys of
    ``chars`` characters together, it becomes the old generation, and entries asked for again move back.
    Nothing in use is lost between calls of ``lacks``."""

    def __init__(self, limit: int, chars: int = 16_000_000):
        self.limit, self.chars, self.held, self.young, self.old = limit, chars, 0, {}, {}

    def __len__(self) -> int:
        return len(self.young)

    def lacks(self, wanted: set) -> list:
        """Those of ``wanted`` that are not known; the others are in ``young`` afterwards."""
        if len(self.young) > self.limit or self.held > self.chars:
            self.old, self.young, self.held = self.young, {}, 0
        missing = wanted.difference(self.young)
        self.held += sum(map(len, missing))
        if self.old:
            old = self.old
            known = [w for w in missing if w in old]
            self.young.update((w, old[w]) for w in known)
            missing.difference_update(known)
        return list(missing)


def running(spark: SparkSession, frame: DataFrame, group: list[str], order: list[str], totals: dict[str, tuple[str, str]],
            folder: str, name: str) -> DataFrame:
    """``frame`` with running totals over the rows of each group in ``order``, a row's own value included.

    ``totals`` maps a new column to ("sum" or "xor", column). A group of any size is spread over tasks:
    rows are dealt by ranges of group and order (equal rows too, by their number) and written with their
    range, each range is totalled for itself, and what a group has in the ranges before is added from a
    table of the groups that cross into another range: two rows a range at most, so it is broadcast."""
    number, at = unused(frame, "number", "range")
    dealt = frame.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(*group, *order, number)
    placed = written(spark, dealt.withColumn(at, F.spark_partition_id()), folder, name)
    total = {"sum": F.sum, "xor": F.bit_xor}
    within = Window.partitionBy(at, *group).orderBy(*order, number).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumns({new: total[kind](column).over(within) for new, (kind, column) in totals.items()})
    parts = placed.groupBy(at, *group).agg(*[total[kind](column).alias(new) for new, (kind, column) in totals.items()])
    if group:
        crossing = parts.groupBy(*group).agg(F.count("*").alias(number)).where(F.col(number) > 1).select(*group)
        parts = parts.join(crossing, group)
    earlier = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(at, *group, *[total[kind](new).over(earlier).alias(f"{new} before") for new, (kind, _) in totals.items()])
    joined = here.join(F.broadcast(before), [at, *group], "left")
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    return joined.select(*frame.columns, *[add[kind](F.col(new), F.coalesce(F.col(f"`{new} before`"), F.lit(0))).alias(new) for new, (kind, _) in totals.items()])
