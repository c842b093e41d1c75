"""Mixing sources to target weights by systematic sampling.

The expected copies of a document are its source's target over the source's size.  Their running
sum within the source, moved by one random offset, gives a copy at each whole number that it
crosses, so that a source's copies differ from their expectation by less than one.  Documents
run in the order of their sizes: each stretch of like sizes is then taken in the same share, and
the words taken stay near the target too.

The running sum needs no source in one task: documents are counted in cells of source, size and
part (by a hash of their id), cells are summed up per source, and only ranks inside a cell come
from the documents themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import free_name, prepare

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
COPIES = 3
#: Parts of the documents of one source and size, as hex digits of the hash.
PART_DIGITS = 2
SEED = "mix"


def cycle_weights(rank: Column) -> Column:
    """1, 2, 3, repeating, for ranks from 1."""
    return (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")


def source_targets(sizes: DataFrame, copies: int = COPIES) -> DataFrame:
    """source, source_size, target for sizes (source, size) of one row a source.

    The words of all sources are shared by weight; a target stops at `copies` times its
    source's size, and what is left over goes to the others by weight.  With the sources in
    order of limit over weight, the first ones stop and the rest share evenly.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", cycle_weights(F.row_number().over(order)))
    rows = rows.withColumn("cap", copies * F.col("size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("size").over(Window.partitionBy()).cast("double")
    level = (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that does not stop holds for all from there on
    shared = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(Window.partitionBy())
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * shared["level"])
    return rows.select("source", F.col("size").alias("source_size"), target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number from 0 to 1 for each source, the same in each run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / (1 << 24)


def with_copies(docs: DataFrame, size: Column, seed: str = SEED, copies: int = COPIES, order: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row of `docs` (doc_id, source, text).

    Order within a source: size, hash of doc_id (or of `order`, a text), doc_id.  A source that is NULL is a source of its
    own, after all others; rows of NULL or equal ids are ordered among themselves in any way,
    which changes no sum.  Sources without words have the target 0 and no copies.
    """
    prepare(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string") if order is None else order, F.lit("")))
    rows = docs.select("doc_id", "source", size.cast("long").alias("size"), digest.alias("digest"))
    rows = rows.withColumn("part", F.substring(F.col("digest"), 1, PART_DIGITS)).checkpoint()
    cells = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    targets = source_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")))
    # ranks before each cell: cells of one size first, then the sizes of a source
    of_size = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.select("source", "size", F.coalesce(F.sum("n").over(of_source), F.lit(0)).alias("smaller"))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(of_size), F.lit(0)))

    def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
        out = F.lit(True)
        for key in keys:
            out = out & a[key].eqNullSafe(b[key])
        return out

    cells = cells.join(sizes, same(cells, sizes, ["source", "size"])).select(
        cells["source"], cells["size"], "part", (F.col("before") + F.col("smaller")).alias("before")
    )
    cells = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).select(
        cells["source"], "size", "part", "before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "size", "part").orderBy("digest", "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(inside))
    rows = rows.join(cells, same(rows, cells, ["source", "size", "part"])).select(
        "doc_id", rows["source"], rows["size"], "source_size", "target", (F.col("before") + F.col("rank")).alias("rank")
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shift = offset(F.col("source"), seed)
    crossed = F.floor(F.col("rank") * each + shift) - F.floor((F.col("rank") - 1) * each + shift)
    return rows.withColumn("copies", crossed.cast("int"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, all columns, each as often as it is taken.

    Rows are told apart by a number given to them in a stored copy, so equal ids are no matter.  What is
    taken follows doc_id and text alone, however the rows lie in files and partitions.
    """
    from timberline.llm.common import stored

    prepare(docs.sparkSession)
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    order = F.concat_ws(":", F.col("id").cast("string"), F.sha2(F.col("text").cast("binary"), 256))
    numbered = rows.select(F.col(row).alias("doc_id"), "source", "text", F.col("doc_id").alias("id"))
    taken = with_copies(numbered, word_count(F.col("text")), seed, order=order)
    times = free_name(docs, "copies")
    taken = taken.where(F.col("copies") > 0).select(F.col("doc_id").alias(row), F.col("copies").alias(times))
    many = rows.join(taken, row)
    return many.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
