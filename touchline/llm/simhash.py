"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, linked groups."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import ROW_GROUP, components, cut, drop_folder, leader_links, release, scratch, shingle_hashes, shingle_set, table, tidy
from touchline.llm.registry import query

#: Fingerprint bits are cut into four blocks; two fingerprints that differ in two bits agree in two blocks at least.
BLOCKS, BLOCK_BITS, MOST_BITS = 4, 16, 2
#: Buckets of up to so many different fingerprints are compared in pairs; the members of larger ones meet at neighbouring points.
PAIRS_UP_TO = 32


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: a bit is 1 if set in over half of the shingle hashes, repeats included; 0 for a text without words."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
            n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts have fingerprint 0. Only the columns doc_id and text are read."""
    return docs.select("doc_id", _fp(words)("text").alias("fp"))


def _fp(words: int):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))
    return fp


def _blocks():
    """Each pair of blocks as (number, mask)."""
    one = (1 << BLOCK_BITS) - 1
    masks = [one << (BLOCK_BITS * i) | one << (BLOCK_BITS * j) for i in range(BLOCKS) for j in range(i)]
    return [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(masks)]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints of the column fp that connect all pairs within two bits.

    Rows are keyed by two of four blocks. A bucket of few fingerprints is joined with itself and the Hamming distance checked.
    Fingerprints of a large bucket (near copies of one text) are not paired: each gets the 65 points within one bit of it, and
    two fingerprints share such a point exactly if they differ in at most two bits; all who share one are linked to its smallest.
    """
    keyed = cut(fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in _blocks()])).alias("x")).select("fp", "x.k", "x.v"))
    sizes = cut(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(keyed.join(sizes, ["k", "v"]))
    few = shared.where(F.col("n") <= PAIRS_UP_TO)
    pairs = (few.select("k", "v", F.col("fp").alias("b")).join(few.select("k", "v", F.col("fp").alias("a")), ["k", "v"])
             .where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b"))
    points = cut(shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct().select("fp", F.explode(F.array(
        F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])).alias("at")))
    least = cut(points.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    met = points.join(least, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(met).distinct()


def near_classes(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked by steps of at most two bits share the smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay; a null doc_id stays null and
    takes part, and is the component_id only of groups without any other id. An empty table gives no rows.
    """
    each = cut(fingerprints(docs, words))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(fps))
    rooted = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    of_fp = cut(rooted.join(least, "root").select("fp", "component_id"))
    return each.join(of_fp, "fp").select("doc_id", "fp", "component_id")


#: Counters of the sketch of shingle counts, and the blocks they are summed in.
SLOTS, SKETCH_BLOCKS = 1 << 20, 64


def shingle_counts(docs: DataFrame, words: int = 5) -> np.ndarray:
    """Sketch of how many texts of docs hold each shingle: one counter for all hashes that agree modulo SLOTS. All rows count; each task sends its counters once."""
    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0):  # one text at a time is a Python string
                slots = (_distinct(t.as_py(), words) & np.uint64(SLOTS - 1)).astype(np.int64)
                if len(slots) > SLOTS // 8:
                    total += np.bincount(slots, minlength=SLOTS)
                else:
                    np.add.at(total, slots, 1)
        if total.any():
            yield pa.record_batch({"k": pa.array(range(SKETCH_BLOCKS), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, SKETCH_BLOCKS)], pa.binary())})

    def add(part):
        return pd.DataFrame({"k": part["k"][:1], "counts": [sum(np.frombuffer(x, np.int64) for x in part["counts"]).tobytes()]})

    kind, total = "k int, counts binary", np.zeros((SKETCH_BLOCKS, SLOTS // SKETCH_BLOCKS), np.int64)
    for k, counts in docs.select("text").mapInArrow(tidy(count), kind).groupBy("k").applyInPandas(add, kind).collect():
        total[k] = np.frombuffer(counts, np.int64)
    return total.ravel()


def _distinct(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def prefix(text: str | None, counts: np.ndarray, similarity: float, words: int) -> tuple[int, np.ndarray]:
    """Number n of different shingles of a text, and of the n - ceil(similarity * n) + 1 that come first by (count, hash) those that another text can hold.

    Two texts of that Jaccard likeness share ceil(similarity * n) shingles of either at least, so the first of them lies among these of both. That holds for any
    one order of all shingles; rare ones come first so that few texts share them.
    """
    found = _distinct(text, words)
    most = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    first = np.lexsort((found, counts[(found & np.uint64(SLOTS - 1)).astype(np.int64)]))[:most]
    lone = counts[(found[first] & np.uint64(SLOTS - 1)).astype(np.int64)] < 2  # no other text holds it
    return len(found), found[first[~lone]].view(np.int64)


#: Rows that leave a Python worker together.
OUT_ROWS = 500


def _lists(rows, kind: pa.DataType) -> pa.ListArray:
    """numpy arrays as one Arrow column of lists."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def likeness_links(docs: DataFrame, texts: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Links (a, b) between the different texts (id, first doc_id) of docs that connect all pairs of Jaccard likeness `similarity` or more over shingles of `words` words.

    Candidates are all pairs that share a shingle of their prefixes: no pair of that likeness is missed, whatever its length (shingles count as equal if their hashes do).
    Passages that many documents share come last in the order and bring no candidates. In a family of near copies not all pairs are formed (leader_links).
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(docs, words))

    def shingled(batches):
        for b in batches:
            ids = b.column(0)
            for at in range(0, b.num_rows, OUT_ROWS):
                found = [(*prefix(t, counts.value, similarity, words), shingle_set(t, words)) for t in (x.as_py() for x in b.column(1).slice(at, OUT_ROWS))]
                n, segs, sets = zip(*found, strict=True)
                yield pa.record_batch({"id": ids.slice(at, OUT_ROWS), "n": pa.array(n, pa.int32()), "segs": _lists(segs, pa.int64()), "set": _lists(sets, pa.int32())})

    # texts stay where they are: one pass writes what is compared later, and only prefixes are joined
    path = scratch(spark, "shingled")
    kind = "id long, n int, segs array<bigint>, set array<int>"
    docs.select(_text_id().alias("id"), "text").mapInArrow(tidy(shingled), kind).write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    each = spark.read.parquet(path)
    rows = each.select("id", "n", F.explode("segs").alias("seg"))
    shared = cut(rows.groupBy("seg").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("seg"))
    release(spark)
    alive = cut(rows.join(shared, "seg").distinct())
    del shared
    release(spark)
    sets = each.select("id", "set").join(alive.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    found = leader_links(alive, sets, similarity)
    drop_folder(spark, path)
    return found


def _text_id():
    """Number of a text: equal for equal texts, null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of docs without those of a near-duplicate group's other documents; all columns stay.

    Groups are the connected components of all different texts, linked if their fingerprints are (near_classes) or if they are alike
    (likeness_links). The smallest doc_id of a group stays. Rows with a null doc_id cannot be named and stay; rows sharing a doc_id are one document
    and share its fate. Null and empty texts are one group. An empty table gives no rows.
    """
    named = docs.where("doc_id is not null")

    def printed(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), 3) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "id", "fp"])

    asked = named.select("doc_id", _text_id().alias("id"), "text")
    each = cut(asked.mapInArrow(tidy(printed), T.StructType([asked.schema["doc_id"], asked.schema["id"], T.StructField("fp", T.LongType())])))
    texts = cut(each.groupBy("id").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")))
    of_fp = cut(texts.groupBy("fp").agg(F.min("id").alias("id")))
    near = of_fp.withColumnRenamed("id", "least")
    alike = links(of_fp.select("fp"))
    tied = texts.join(near, "fp").select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")
    across = alike.join(of_fp.select(F.col("fp").alias("a"), F.col("id").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("id").alias("y")), "b")
    tied = cut(tied.unionByName(across.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    del each, of_fp, near, alike, across
    release(docs.sparkSession)
    groups = components(tied.unionByName(likeness_links(named, texts, similarity, words)))
    rooted = texts.join(groups.withColumnRenamed("node", "id"), "id", "left").select("first", F.coalesce("root", "id").alias("root"))
    stay = cut(rooted.groupBy("root").agg(F.min("first").alias("doc_id")).select("doc_id").distinct())
    return named.join(stay, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


@query("op9_simhash")
def op9_simhash(spark, sf_dir):
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
