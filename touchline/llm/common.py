"""Shared pieces: reading tables, shuffle width, scratch folders, word shingles, components."""
from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.session import cut, ensure_checkpoint_dir

SEED = 42
#: Bytes of a row group of tables between steps: a task holds one while it writes.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, for tables that Spark writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished rounds: Spark deletes their shuffle files (and checkpoints, if told to) once nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run, forget=None):
    """run, for mapInPandas or mapInArrow, with an end: Python workers outlive their tasks and wait beside those of later stages, so a finished task forgets its caches and gives freed memory back."""
    def each(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            trim()

    return each


def trim() -> None:
    """Give freed memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pieces(data: bytes, block: int = 1 << 20):
    """Cut bytes at white space into pieces of about `block` bytes, so a very long text is never split as a whole."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + block)
        while end < n and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end]
        at = end


def shingle_hashes(text: str | None, words: int, seed: int = SEED):
    """Arrays of XXH64 hashes of the word shingles of a text, repeats included.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; a text of fewer words gives one
    shingle of all its words, a text without words (or null) none.
    """
    digest, carry, seen = xxhash.xxh64_intdigest, [], 0
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        new = piece.split()
        seen += len(new)
        run = carry + new
        if len(run) >= words:
            joined = b" ".join(run)
            ends = np.cumsum([len(w) + 1 for w in run]) - 1
            starts = ends - np.array([len(w) for w in run])
            yield np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[: len(run) - words + 1].tolist(), ends[words - 1:].tolist())),
                              np.uint64, len(run) - words + 1)
        carry = run[max(0, len(run) - words + 1):] if words > 1 else []
    if 0 < seen < words:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text as 32-bit hashes (half of each 64-bit hash; two shingles of a pair of texts seldom share one)."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *[(h >> np.uint64(32)).astype(np.uint32) for h in shingle_hashes(text, words)]])).view(np.int32)


def leader_links(alive: DataFrame, sets: DataFrame, similarity: float, leaders: int = 1) -> DataFrame:
    """Links (a, b) of Jaccard likeness `similarity` or more between members of common buckets (seg, id, n); sets are (id, set array of n).

    The links connect exactly what all such pairs connect, but not all pairs are formed. In each round the first members of a bucket lead it: they are
    compared with all other members that are not yet in their component, and leave it. Members found alike stay and lead later, after those who
    stand for a component. A bucket ends once all its members are in one component, so a family of near copies ends after its first leaders. The number of leaders
    doubles each round. Sizes whose ratio is below `similarity` rule a pair out before its sets are read.
    """
    by_seg, links, spark = Window.partitionBy("seg"), None, sets.sparkSession
    alive = cut(alive.select("seg", "id", "n", F.col("id").alias("root")))
    path = scratch(spark, "sets")
    sets.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    sets = spark.read.parquet(path)
    while alive.limit(1).count():
        ranked = cut(alive.withColumn("r", F.row_number().over(by_seg.orderBy(F.col("id") != F.col("root"), "id"))))
        lead = ranked.where(F.col("r") <= leaders).select("seg", *[F.col(c).alias(f"lead_{c}") for c in ("id", "n", "root", "r")])
        pairs = ranked.join(lead, "seg").where((F.col("lead_r") < F.col("r")) & (F.col("lead_root") != F.col("root")))
        pairs = pairs.where(F.least("n", "lead_n") >= F.lit(similarity - 1e-9) * F.greatest("n", "lead_n"))
        pairs = cut(pairs.select(F.greatest("id", "lead_id").alias("a"), F.least("id", "lead_id").alias("b"), F.greatest("root", "lead_root").alias("p"), F.least("root", "lead_root").alias("q")).distinct())
        asked = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
        asked_path = scratch(spark, "asked")
        asked.write.option("parquet.block.size", str(ROW_GROUP)).parquet(asked_path)
        asked = spark.read.parquet(asked_path)
        both = pairs.join(asked.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(asked.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        same = F.size(F.array_intersect("x", "y"))
        found = cut(both.where(same >= F.lit(similarity - 1e-9) * (F.size("x") + F.size("y") - same)).select("a", "b", "p", "q"))
        drop_folder(spark, asked_path)
        links = found.select("a", "b") if links is None else links.unionByName(found.select("a", "b"))
        moved = components(found.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
        rest = ranked.where(F.col("r") > leaders).join(moved, "root", "left").select("seg", "id", "n", F.coalesce("to", "root").alias("root"))
        split = rest.withColumn("low", F.min("root").over(by_seg)).withColumn("high", F.max("root").over(by_seg)).where("low <> high")
        alive = cut(split.select("seg", "id", "n", "root"))
        leaders *= 2
        del ranked, lead, pairs, asked, both, found, moved, rest, split
        release(spark)
        # only the sets of members that are still compared are read on
        left = scratch(spark, "sets")
        sets.join(alive.select("id").distinct(), "id", "left_semi").write.option("parquet.block.size", str(ROW_GROUP)).parquet(left)
        drop_folder(spark, path)
        path, sets = left, spark.read.parquet(left)
    kind = sets.schema["id"].dataType.simpleString()
    drop_folder(spark, path)
    return spark.createDataFrame([], f"a {kind}, b {kind}") if links is None else links


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): every node of them with the smallest node it can reach, as (node, root).

    Large-star and small-star rounds (Kiveris et al. 2014) until only stars are left: each round is two joins with a per-node minimum, and
    the number of rounds grows with the logarithm of the longest path. Lineage is cut by a reliable checkpoint in each round.
    Nulls and self-links are ignored; repeated links count once. A hub's links are joined to one minimum each, and both
    sides of that join are plain shuffles, which adaptive execution may split.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = cut(joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        del both, low, large, joined
        release(edges.sparkSession)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one link downwards or is only linked to from above: then all links lead to the smallest node of their component."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: a lambda that names an expression would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(sizes: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array of integers, in two levels so that long arrays stay cheap. Null gives null, an empty array an empty one."""
    def of_block(s, b, n):
        return F.aggregate(F.slice(s, b * block + 1, n), F.lit(0), lambda a, x: a + x)

    def sums(s):
        whole = F.transform(F.sequence(F.lit(0), (F.size(s) / block).cast("int")), lambda b: of_block(s, b, F.lit(block)))
        before = let(whole, lambda w: F.aggregate(w, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
        return let(before, lambda p: F.transform(s, lambda x, i: F.element_at(p, (i / block).cast("int") + 1) + of_block(s, (i / block).cast("int"), i % block + 1)))

    return let(sizes, sums)


def ranges(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with `bucket`: the number of range bounds at or below the key, so that buckets follow the order of the key.

    The bounds are quantiles of the key over all of `ids` (only that column is read), a few times as many as the shuffle is wide, so that
    several small buckets even out in a task; nulls lie in bucket -1.
    """
    n = max(width(ids.sparkSession), min(4 * width(ids.sparkSession), 4096))
    bounds = ids.select(F.percentile_approx(key, [i / n for i in range(1, n)], 100_000).alias("q")).first()["q"] if n > 1 else None
    bounds = sorted(set(bounds or []))
    place = F.lit(0)
    if bounds:
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
    return rows.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(place))
