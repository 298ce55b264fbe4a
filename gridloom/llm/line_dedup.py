"""Line deduplication by a suffix array over line ids.

Documents are sequences of line ids. Only lines found at least twice can lie in a repeated run, so
positions of other lines part the sequences into spans, whose lines are numbered through (``idx``) in the
order of document id and line: a suffix is a number and the number of its span's last line.

Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines, a shorter suffix before longer ones: a
level's ranks are the order of pairs of ranks of the level before, sorted by range over the cluster. The last
level, whose prefixes are as long as any run that is asked for, orders the suffix array. The longest common
prefix of neighbours in it comes from a descent through the levels: from the longest on, equal ranks of the
two suffixes carry both by so many lines.

A line is deleted if it lies in a run of consecutive lines that holds ``min_words`` words or more and stands,
line by line the same, at an earlier place. Every maximal such run is the union of shortest ones: from each
line forward, and from each line backward, the run that just reaches ``min_words``. What a shortest run is
follows from its lines alone, so all suffixes that begin with its lines ask for its length. They stand side by
side in the suffix array, and neighbours belong together where their common prefix has that length: an
interval of the array is a stretch without a break, found by running totals over ranges of it. Its earliest
suffix stays; the others are later copies.

Everything here is DataFrame operations.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_GAP, drop_dir, running, shared_dir, written


def _ranked(spark, distinct: DataFrame, columns: list[str], folder: str, name: str) -> DataFrame:
    """``distinct`` with ``rank``: numbers in the order of ``columns``, found by a range sort."""
    order = [F.col(c) for c in columns]
    sorted_ = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(spark, sorted_.withColumn("rank", F.monotonically_increasing_id()), folder, name)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("own"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
            .select("doc", "own", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")))


def _shortest_runs(here: DataFrame, min_words: int) -> DataFrame:
    """idx (first line) and size of the shortest runs of ``min_words`` words from each line forward and backward."""
    none = F.lit(None).cast("long")
    row = lambda frame, v, kind, mark, idx: frame.select("last", v.alias("v"), F.lit(kind).alias("kind"), mark.alias("mark"), idx.alias("idx"))
    starts = row(here, F.col("before"), 0, F.col("idx"), none)
    ends = row(here.where("idx = last"), F.col("upto"), 0, F.col("idx") + 1, none)
    asked = row(here, F.col("before") + min_words, 1, none, F.col("idx"))
    down = Window.partitionBy("last").orderBy(F.desc("v"), "kind", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    forward = (starts.unionByName(ends).unionByName(asked).withColumn("stop", F.last("mark", ignorenulls=True).over(down))
               .where("kind = 1 and stop is not null").select("idx", (F.col("stop") - F.col("idx")).alias("size")))
    asked = row(here, F.col("upto") - min_words, 1, none, F.col("idx"))
    upward = Window.partitionBy("last").orderBy("v", "kind", "mark").rowsBetween(Window.unboundedPreceding, 0)
    backward = (starts.unionByName(asked).withColumn("first", F.last("mark", ignorenulls=True).over(upward))
                .where("kind = 1 and first is not null").select(F.col("first").alias("idx"), (F.col("idx") - F.col("first") + 1).alias("size")))
    return forward.unionByName(backward).distinct()


def suffix_levels(spark, lines: DataFrame, length: int, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of idx and rank, and the suffixes with the ranks that order them.

    Level k ranks the suffixes of ``lines`` (idx, last, rank) by their first 2**k lines, up to the first level that
    reaches ``length`` lines. A suffix whose lines the level before has all is not ranked again: its array of
    ranks ends there, and so stands before those that go on."""
    level = lines.select("idx", "last", "rank", F.array("rank").alias("ranks"))
    levels, done = [level], []
    while 1 << (len(levels) - 1) < length:
        k = len(levels)
        half = 1 << (k - 1)
        longer = F.col("idx") + half <= F.col("last")
        # Suffixes that ended before are second halves, too: arrays of ranks are in their order.
        over = functools.reduce(DataFrame.unionByName, [x.select("idx", "ranks") for x in (level, *done)])
        over = over.select((F.col("idx") - half).alias("idx"), F.col("ranks").alias("two"))
        done.append(level.where(~longer).select("idx", "last", "ranks"))
        pairs = level.where(longer).withColumnRenamed("rank", "one").join(over, "idx")
        pairs = written(spark, pairs, folder, f"pairs{k}")
        ranks = _ranked(spark, pairs.select("one", "two").distinct(), ["one", "two"], folder, f"ranks{k}")  # written, so the join's hot pairs can be split
        level = pairs.join(ranks, ["one", "two"]).select("idx", "last", "rank", F.concat("ranks", F.array("rank")).alias("ranks"))
        level = written(spark, level, folder, f"level{k}")
        levels.append(level)
    every = functools.reduce(DataFrame.unionByName, done, level.select("idx", "last", "ranks"))
    return [x.select("idx", "rank") for x in levels], every


def common_prefixes(spark, array: DataFrame, levels: list[DataFrame], folder: str) -> DataFrame:
    """place and lcp: lines that the suffix at each place of ``array`` (place, idx, last) shares with the one
    before it, counted as far as twice the last level's length less one."""
    left = F.col("last") - F.col("idx") + 1
    before = array.select((F.col("place") + 1).alias("place"), F.col("idx").alias("y"), left.alias("left_y"))
    pairs = array.select("place", F.col("idx").alias("x"), left.alias("left_x")).join(before, "place")
    pairs = pairs.select("place", "x", "y", F.least("left_x", "left_y").cast("int").alias("left"), F.lit(0).alias("lcp"))
    pairs = written(spark, pairs, folder, "neighbours")
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k  # both go on from x and y, as far as they have lines left
        side = lambda name: levels[k].select(F.col("idx").alias(name), F.col("rank").alias(f"rank_{name}"))
        both = pairs.where(F.col("left") >= step).join(side("x"), "x").join(side("y"), "y")
        on = F.when(F.col("rank_x") == F.col("rank_y"), step).otherwise(0)
        both = both.select("place", (F.col("x") + on).alias("x"), (F.col("y") + on).alias("y"), (F.col("left") - on).alias("left"), (F.col("lcp") + on).alias("lcp"))
        pairs = written(spark, both.unionByName(pairs.where(F.col("left") < step)), folder, f"prefix{k}")
    return pairs.select("place", "lcp")


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Runs to delete: doc, own (hash of the text), pos (first line), size (lines). Runs may overlap.
    Tables of the steps go to ``folder`` and are needed until the result has been read."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    lines = _lines(docs, id_col, text_col)
    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    names = _ranked(spark, again, ["h1", "h2"], folder, "names")
    words = F.size(F.filter(F.split("line", WORD_GAP), lambda w: w != ""))
    here = lines.select("doc", "own", "pos", "h1", "h2", words.alias("w")).join(names, ["h1", "h2"]).select("doc", "own", "pos", "w", "rank")
    # Rows repeated as a whole are one document, so each of its lines counts once.
    here = here.repartition("doc", "own").dropDuplicates(["doc", "own", "pos"])
    in_doc = Window.partitionBy("doc", "own").orderBy("pos")
    here = here.withColumn("span", F.col("pos") - F.row_number().over(in_doc))
    span = Window.partitionBy("doc", "own", "span")
    here = here.withColumn("upto", F.sum("w").over(span.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("w"))
    here = here.withColumns({"total": F.max("upto").over(span), "end": F.max("pos").over(span)}).where(F.col("total") >= min_words)
    here = running(spark, here.withColumn("one", F.lit(1).cast("long")), [], ["doc", "own", "pos"], {"idx": ("sum", "one")}, folder, "lines")
    here = written(spark, here.select("doc", "own", "pos", "idx", (F.col("idx") + F.col("end") - F.col("pos")).alias("last"), "rank", "upto", "before"), folder, "here")

    runs = written(spark, _shortest_runs(here, min_words), folder, "runs")
    length = runs.agg(F.max("size")).first()[0]
    if length is None:
        return here.select("doc", "own", "pos", F.lit(0).alias("size")).limit(0)
    levels, suffixes = suffix_levels(spark, here, length, folder)
    asking = written(spark, runs.select("idx").distinct(), folder, "asking")
    ordered = suffixes.join(asking, "idx").withColumn("one", F.lit(1).cast("long"))
    array = written(spark, running(spark, ordered, [], ["ranks", "idx"], {"place": ("sum", "one")}, folder, "sorted").select("place", "idx", "last"), folder, "array")
    prefixes = written(spark, common_prefixes(spark, array, levels, folder), folder, "prefixes")
    placed = runs.join(array.select("idx", "place"), "idx").join(prefixes, "place", "left")
    breaks = placed.select("size", "place", "idx", F.when(F.col("lcp") >= F.col("size"), 0).otherwise(1).cast("long").alias("breaks"))
    found = running(spark, breaks, ["size"], ["place"], {"interval": ("sum", "breaks")}, folder, "breaks").select("size", "interval", "idx")
    # An interval's earliest suffix stays; the others are later copies.
    found = written(spark, found, folder, "intervals")
    earliest = found.groupBy("size", "interval").agg(F.min("idx").alias("kept"), F.count("*").alias("c")).where("c > 1").select("size", "interval", "kept")
    later = found.join(written(spark, earliest, folder, "earliest"), ["size", "interval"]).where("idx <> kept").select("idx", "size")
    return here.select("doc", "own", "pos", "idx").join(written(spark, later, folder, "later"), "idx").select("doc", "own", "pos", F.col("size").cast("int").alias("size"))


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and two columns more:
    ``n_lines`` and ``removed_lines`` (numbers of the deleted lines, from 0, ascending).

    Lines are parted by \\n. Every row stays, a document all of whose lines go with an empty text. A
    null text stays null and has no lines removed. Null ids come first in the order of copies. Rows
    that repeat as a whole are one document and are treated alike; rows that share an id but not the
    text are told apart by the text. An empty table stays empty; other columns stay as they are
    (columns named like the two new ones are replaced).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    gone = repeated_runs(docs, min_words, id_col, text_col, folder)
    gone = (gone.select("doc", "own", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("line"))
            .groupBy("doc", "own").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    # Written first: a join of two plain exchanges is one whose hot keys Spark can split.
    gone = written(spark, gone, shared_dir(spark), "gone")
    drop_dir(spark, folder)
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines")]
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").alias("doc_"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("own_"))
    # The plan of any size: what goes grows with the corpus, so it is not broadcast.
    joined = rows.join(gone.hint("merge"), F.col("doc_").eqNullSafe(F.col("doc")) & (F.col("own_") == F.col("own")), "left")
    whole = F.col("row")[text_col]
    lines = F.split(whole, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    none = F.array().cast("array<int>")
    return joined.select(
        *[F.when(F.col("gone").isNull(), whole).otherwise(left).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("gone", none).alias("removed_lines"))


def line_dedup_query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "text")
