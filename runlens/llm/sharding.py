"""Sharding: a shuffle of all rows into shards of exact sizes, by a matrix of how many rows each file sends to each shard.

The matrix is drawn from the multivariate hypergeometric law, the law of these counts under a uniform shuffle: a tree splits
the files in halves and draws how many places of every shard the left half takes. A row's place then follows from
its file and its index in the file alone: permuted in the file, cut into shards by the file's row of the matrix, and
permuted again in the shard. No step ranks or sorts rows, rows move once, and a lost task finds the same places again.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.common import materialize

#: Rounds of a permutation: each pairs all places and swaps half of the pairs by a coin, so what two places have in common halves.
ROUNDS = 64


def permuted(place: Column, n: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """A pseudo-random permutation of 0 .. n - 1, by swap-or-not rounds: each salt gives another one. n is at least 1."""
    keys = F.array(*[F.xxhash64(F.lit(r), F.lit("round")) for r in range(rounds)])

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(F.pmod(key.bitwiseXOR(salt), n) - x, n)
        return F.when(F.xxhash64(salt, key, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, place, step)


def hypergeometric(drawn: Column, marked: Column, all_: Column, u: Column) -> Column:
    """How many of `drawn` things out of all_ are marked: the place of u (0 to 1) in the distribution, found by walking over it.

    The walk covers 12 standard deviations and 12 things about the mean; what lies outside has odds of less than 1e-30.
    """
    mean = drawn * marked.cast("double") / F.greatest(all_, F.lit(1))
    spread = F.sqrt(mean * (all_ - marked) / F.greatest(all_, F.lit(1)) * (all_ - drawn) / F.greatest(all_ - 1, F.lit(1)))
    low = F.greatest(F.lit(0), drawn + marked - all_, F.floor(mean - 12 * spread - 12))
    high = F.least(drawn, marked, F.ceil(mean + 12 * spread + 12))
    following = lambda x: (marked - x).cast("double") * (drawn - x) / ((x + 1).cast("double") * F.greatest(all_ - marked - drawn + x + 1, F.lit(1)))
    total = F.aggregate(F.sequence(low, high), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda a, x: F.struct((a["w"] * following(x)).alias("w"), (a["sum"] + a["w"]).alias("sum")))["sum"]
    start = F.struct(F.lit(1.0).alias("w"), (u * total).alias("left"), low.alias("x"))
    walk = lambda a, x: F.when(a["left"] <= 0, a).otherwise(F.struct((a["w"] * following(x)).alias("w"), (a["left"] - a["w"]).alias("left"), x.alias("x")))
    return F.aggregate(F.sequence(low, high), start, walk)["x"]


def communication_matrix(files: DataFrame, n_files: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """files (file, n) -> (file, place, n, sent, base): each file's place by name, how many rows it sends to each shard, and how many the files before it send there.

    sizes are the shards' rows, in all as many as the files have. The files are one array in one row, as the driver lists them
    itself; each level of the tree halves the arrays, so there are as many explodes as levels, and no exchange.
    """
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
    rooms, none = F.array(*[F.lit(s).cast("long") for s in sizes]), F.array(*[F.lit(0).cast("long") for _ in sizes])
    nodes = files.agg(F.sort_array(F.collect_list(F.struct("file", "n"))).alias("files")).select("files", rooms.alias("room"), none.alias("base"), F.lit(0).alias("place"))

    def drawn(a: Column, k: Column) -> Column:
        marked, need = F.get("room", k), F.col("_n") - total(a["out"])
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.size("files"), F.col("place"), k), 11) + 0.5) / float(1 << 53)
        return F.struct((a["rest"] - marked).alias("rest"), F.array_append(a["out"], hypergeometric(need, marked, a["rest"], u)).alias("out"))

    for _ in range(max(0, n_files - 1).bit_length()):
        split = nodes.withColumn("_half", F.floor(F.size("files") / 2).cast("int")).withColumn("_left", F.slice("files", 1, F.greatest(F.col("_half"), F.lit(1))))
        split = split.withColumn("_n", total(F.transform("_left", lambda f: f["n"])))
        start = F.struct(total(F.col("room")).alias("rest"), F.array().cast("array<bigint>").alias("out"))
        split = split.withColumn("_drawn", F.when(F.col("_half") > 0, F.aggregate(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), start, drawn)["out"]))
        left = F.struct(F.col("_left").alias("files"), F.coalesce("_drawn", "room").alias("room"), F.col("base"), F.col("place"))
        right = F.struct(
            F.slice("files", F.col("_half") + 1, F.size("files") - F.col("_half")).alias("files"),
            F.zip_with("room", "_drawn", lambda a, b: a - b).alias("room"),
            F.zip_with("base", "_drawn", lambda a, b: a + b).alias("base"),
            (F.col("place") + F.col("_half")).alias("place"),
        )
        nodes = split.select(F.explode(F.when(F.col("_half") > 0, F.array(left, right)).otherwise(F.array(left))).alias("node")).select("node.*")
    file = F.get("files", F.lit(0))
    return nodes.where(F.size("files") > 0).select(file["file"].alias("file"), "place", file["n"].alias("n"), F.col("room").alias("sent"), "base")


def shard_files(spark: SparkSession, path: str, shards: int = 8, seed: int = 0, rows_per_part: int = 20_000, most_files: int = 20_000) -> DataFrame:
    """The Parquet table at path with shard (0 to shards - 1) and slot (place in the shard, gapless from 0): shards whose rows differ by at most one.

    Every row is there once, rows that repeat too; each shard's rows come in the order of their slots, in parts of rows_per_part
    rows. The same files in the same order with the same seed give the same shards. Broadcast is a row of some 300 bytes for
    each file; a table of more than most_files files is first written again as so many. Null and clashing columns pass
    through, but for shard and slot, which are replaced. An empty table gives an empty one.
    """
    docs = spark.read.parquet(path)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    files = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    n_files, rows = files.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_files > most_files:
        return shard_rows(docs.coalesce(most_files), shards, seed, rows_per_part)
    sizes = [rows // shards + (k < rows % shards) for k in range(shards)]
    matrix = communication_matrix(files, n_files, sizes, seed)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("sent", 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    told = F.broadcast(matrix.select(F.col("file").alias("_file"), F.col("n").alias("_n"), F.col("base").alias("_base"), cuts.alias("_cuts"), F.xxhash64(F.lit(seed), F.lit("file"), "place").alias("_salt")))
    meta = docs.metadataColumn("_metadata")
    placed = docs.select(*kept, meta["file_path"].alias("_path"), meta["row_index"].alias("_at")).join(told, F.col("_path") == F.col("_file"))
    placed = placed.withColumn("_at", permuted(F.col("_at"), F.col("_n"), F.col("_salt")))
    placed = placed.withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))))
    before = F.when(F.col("shard") > 0, F.get("_cuts", F.col("shard") - 1)).otherwise(0)
    arrived = F.get("_base", F.col("shard")) + F.col("_at") - before
    size = F.get(F.array(*[F.lit(s).cast("long") for s in sizes]), F.col("shard"))
    placed = placed.withColumn("_at", arrived).withColumn("slot", permuted(F.col("_at"), size, F.xxhash64(F.lit(seed), F.lit("shard"), "shard")))
    parts = max(1, -(-sizes[0] // rows_per_part))
    part = (F.col("shard") * parts + F.floor(F.col("slot") / rows_per_part)).cast("int")
    return placed.select(*kept, "shard", "slot").repartitionById(shards * parts, part).sortWithinPartitions("shard", "slot")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, rows_per_part: int = 20_000) -> DataFrame:
    """shard_files for rows that aren't in files as they are: they are written first, as only written rows have places that stay."""
    written = materialize(docs, "shard-rows")
    return shard_files(docs.sparkSession, written._written, shards, seed, rows_per_part, most_files=1 << 31)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes a folder for each shard, whose files hold its rows by slot."""
    sharded.write.partitionBy("shard").parquet(path)
