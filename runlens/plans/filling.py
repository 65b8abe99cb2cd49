"""Ordered batches: the greedy fill over all files, as jump pointers.

Where a batch that begins at a file ends depends on the files behind it alone, so every file gets a pointer to the file where the next
batch would begin. Which files batches do begin at is then found without walking over all: a block of files maps the few
places where a batch can enter it to the places where one enters the next block; blocks of blocks compose these maps, up to one
map, and the way down tells each block where it is entered. No task gets more than a range partition or a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.shared import discard, materialize, positions

#: Blocks whose maps are composed at once.
FAN = 512


def batches(files: DataFrame, max_files: int = 20, max_chars: int = 80_000) -> DataFrame:
    """files (path, dir, n_chars) with batch, numbered from 0 in the order of dir and path.

    A batch takes files in that order up to max_files and max_chars, one file at least, so a larger one is a batch by
    itself. Where that would part a folder that fits into one batch, the batch ends before the folder, unless it begins with
    it: siblings stay together, and small folders share batches. Null sizes count as 0. The same files give the same batches. Other columns
    pass through; no files give no batches. Paths have to differ.
    """
    size = F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("long")
    ordered = positions(files.withColumn("_size", size), ["dir", "path"], {"_before": "_size"})
    folder = Window.partitionBy("dir")
    folders = ordered.groupBy(F.col("dir").alias("_dir")).agg(F.min("_at").alias("_begin"), (F.count("*") <= max_files).alias("_few"), (F.sum("_size") <= max_chars).alias("_small"))
    block = max(1024, 8 * max_files)
    told = ordered.join(folders, F.col("dir").eqNullSafe(F.col("_dir"))).drop("_dir").withColumn("_fits", F.col("_few") & F.col("_small"))
    told = materialize(told.drop("_few", "_small").withColumn("_block", F.floor(F.col("_at") / block)), "files-in-order")

    # The next max_files files of each, with those of the next block where a block ends.
    near = told.select("_block", "_at", "_before", "_size", "_begin", "_fits", F.lit(True).alias("_own"))
    halo = near.where((F.col("_at") % block < max_files) & (F.col("_block") > 0)).withColumns({"_block": F.col("_block") - 1, "_own": F.lit(False)})
    ahead = F.collect_list(F.struct((F.col("_before") + F.col("_size")).alias("end"), F.col("_begin").alias("begin"), F.col("_fits").alias("fits"))).over(Window.partitionBy("_block").orderBy("_at").rowsBetween(0, max_files))
    seen = near.union(halo).withColumn("_ahead", ahead).where("_own")
    taken = F.greatest(F.size(F.filter(F.slice("_ahead", 1, max_files), lambda f: f["end"] - F.col("_before") <= max_chars)), F.lit(1))
    cut = F.get("_ahead", F.col("_n"))  # the first file that isn't taken
    early = (cut["begin"] > F.col("_at")) & (cut["begin"] < F.col("_at") + F.col("_n")) & cut["fits"]
    jumps = seen.withColumn("_n", taken).select("_block", "_at", F.when(early, cut["begin"]).otherwise(F.col("_at") + F.col("_n")).alias("_next"))
    maps = jumps.groupBy(F.col("_block").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_next"))), lambda p: (p["_next"] - F.col("_block") * block).cast("int")).alias("next"))
    maps = materialize(maps, "jumps")

    begins = materialize(_begins(maps, block, max_files), "batch-begins")
    numbered = positions(begins.withColumnRenamed("block", "_b"), ["begin"], {}).select(F.col("begin").alias("_at"), F.col("_b").alias("_block"), F.col("_at").alias("_batch"))
    last = begins.groupBy("block").agg(F.max("begin").alias("_last"))
    last = last.join(numbered.select(F.col("_at").alias("_last"), F.col("_batch").alias("_carried")), "_last").select((F.col("block") + 1).alias("_block"), "_carried")
    rows = told.join(numbered, ["_block", "_at"], "left").join(last, "_block", "left")
    upto = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("batch", F.coalesce(F.max("_batch").over(upto), F.col("_carried"), F.lit(0))).select(*[c for c in files.columns if c != "batch"], "batch")
    return out


def _walk(next_: Column, entry: Column, size: int) -> Column:
    """Where a way of jumps leaves a block of `size` places, counted from its end; a place without a jump ends the way at the block's end."""
    return F.aggregate(next_, entry.cast("int"), lambda at, _: F.when(at < F.size(next_), F.get(next_, at)).otherwise(at), lambda at: F.greatest(at - size, F.lit(0)))


def _begins(maps: DataFrame, block: int, most: int) -> DataFrame:
    """maps (block, next) -> (block, begin): the places that jumps from place 0 on come to."""
    entries = F.sequence(F.lit(0), F.lit(most - 1))
    levels = [materialize(maps.select("block", F.transform(entries, lambda e: _walk(F.col("next"), e, block)).alias("exits")), "exits")]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "exits"))), lambda x: x["exits"]).alias("below"))
        through = F.transform(entries, lambda e: F.aggregate("below", e, lambda at, x: F.get(x, at)))
        levels.append(materialize(up.select("block", through.alias("exits")), "exits"))
    entered = levels.pop().select("block", F.lit(0).alias("entry"))
    while levels:
        below = levels.pop()
        ways = below.groupBy(F.floor(F.col("block") / FAN).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("_below"))
        start = F.struct(F.col("entry").alias("at"), F.array().cast("array<int>").alias("seen"))
        seen = F.aggregate("_below", start, lambda s, x: F.struct(F.get(x["exits"], s["at"]).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen")), lambda s: s["seen"])
        pairs = entered.withColumnRenamed("block", "_up").join(ways, "_up").select(F.explode(F.arrays_zip(F.transform("_below", lambda x: x["block"]).alias("block"), seen.alias("entry"))).alias("p"))
        entered = materialize(pairs.select("p.block", "p.entry"), "entries")
    start = F.struct(F.col("entry").cast("int").alias("at"), F.array().cast("array<int>").alias("seen"))
    inside = F.aggregate("next", start, lambda s, _: F.when(s["at"] < F.size("next"), F.struct(F.get("next", s["at"]).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen"))).otherwise(s), lambda s: s["seen"])
    return entered.join(maps, "block").select("block", F.explode(inside).alias("at")).select("block", (F.col("block") * block + F.col("at")).alias("begin"))
