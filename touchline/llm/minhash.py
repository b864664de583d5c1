"""MinHash fingerprints: many universal hashes over word shingles in numpy, bands joined in Spark, Jaccard verified."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, cut, leader_links, ranges, shingle_hashes, shingle_set, table, width
from touchline.llm.registry import query

WORDS, PERMUTATIONS, CHUNK = 5, 128, 2048
_rng = np.random.default_rng(20240917)
#: Fixed draws of the universal hashes h(x) = high half of (a * x + b), a odd, over 64-bit integers.
A = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2)
_FOLD = (_rng.integers(0, 1 << 63, 5, np.uint64) * np.uint64(2) + np.uint64(1)).view(np.uint64)
EMPTY = np.full(PERMUTATIONS, (1 << 32) - 1, np.uint32)


def signature(parts) -> np.ndarray:
    """Least value of every hash over arrays of shingle hashes; EMPTY without shingles."""
    low = EMPTY.copy()
    for hashes in parts:
        for at in range(0, len(hashes), CHUNK):
            x = hashes[None, at:at + CHUNK] * A[:, None]
            x += B[:, None]
            np.minimum(low, (x >> np.uint64(32)).min(axis=1).astype(np.uint32), out=low)
    return low


def text_signature(text: str | None, words: int = WORDS) -> np.ndarray:
    return signature(np.unique(h) for h in shingle_hashes(text, words))


def as_hex(sig: np.ndarray) -> str:
    """The low 16 bits of every minimum, as hex digits: equal minima give equal fields, different ones differ but for 1 in 65,536."""
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal fields of two fingerprints, an estimate of the Jaccard likeness of the shingle sets; two texts without words are alike."""
    return float(np.mean(a.astype(np.uint16) == b.astype(np.uint16)))


def edited(text: str, nxt: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + nxt[:n]


def fingerprints_with_next(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each document with its fingerprint, its edited text's, and the likeness to that and to the next document's.

    The next document is the one with the next larger doc_id, after the last the first. Documents are dealt to ranges of doc_id and sorted, one
    shuffle of the texts; each range also gets the first document of the following one. Null texts count as empty (no shingle: all such
    are alike). Rows with a null doc_id come first; rows with equal doc_id are ordered by text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = ranges(base, base, "doc_id")
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("f")).collect())
    follow = [(firsts[i - 1][0], f) for i, (_, f) in enumerate(firsts)]  # each range's first document goes to the range before
    heads = spark.createDataFrame(follow, "to int, first long")
    tails = placed.drop("bucket").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", F.col("to").alias("bucket"))
    rows = placed.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    rows = rows.repartition(width(spark), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def run(batches):
        last = None
        for b in batches:
            out = []
            for doc, text, bucket, tail in zip(b["doc_id"], b["text"], b["bucket"], b["tail"]):
                if last is not None and last[3]:
                    if bucket == last[2]:
                        continue  # more rows with the doc_id of the first row of the next range
                    last = None
                sig = text_signature(text, words)
                if last is not None:
                    out.append(_row(last, text, sig, words))
                last = (doc, text, bucket, tail, sig)
            if out:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})

    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(last, nxt: str, next_sig: np.ndarray, words: int):
    doc, text, _, _, sig = last
    other = edited(text, nxt)
    edited_sig = text_signature(other, words)
    return (None if pd.isna(doc) else int(doc), len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
            as_hex(sig), as_hex(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig))


#: Bands of ROWS minima each: texts of likeness 0.8 share one with probability 0.9999.
BANDS, ROWS = 25, 5


def near_classes(docs: DataFrame, similarity: float = 0.8, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the near-duplicate class of each row.

    Equal texts are one text (by their 128-bit digest). Bands of the signatures of different texts are joined, and the Jaccard likeness of shared shingle sets is
    verified; only texts with a shared band carry their sets. Null and empty texts are one class; a null doc_id takes part and names a class only if it is alone.
    """
    @F.pandas_udf("array<bigint>")
    def bands(texts: pd.Series) -> pd.Series:
        return pd.Series([(np.ascontiguousarray(text_signature(t, words)[: BANDS * ROWS].reshape(BANDS, ROWS)).astype(np.uint64) @ _FOLD).view(np.int64) for t in texts], index=texts.index, dtype=object)

    @F.pandas_udf("array<int>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in texts], index=texts.index, dtype=object)

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = cut(base.select("doc_id", F.md5(F.col("text").cast("binary")).alias("id")))
    ids = cut(each.groupBy("id").agg(F.min("doc_id").alias("first")))
    chosen = base.join(ids.where("first is not null").withColumnRenamed("first", "doc_id"), "doc_id").where(F.md5(F.col("text").cast("binary")) == F.col("id"))
    chosen = chosen.unionByName(base.where("doc_id is null").withColumn("id", F.md5(F.col("text").cast("binary"))).join(ids.where("first is null").select("id"), "id").select(*chosen.columns))
    rows = cut(chosen.select("id", F.posexplode(bands("text"))).select("id", F.xxhash64("pos", "col").alias("seg")).distinct())
    held = cut(rows.groupBy("seg").agg(F.count("*").alias("n")).where("n > 1").select("seg"))
    alive = cut(rows.join(held, "seg"))
    sets = cut(chosen.join(cut(alive.select("id").distinct()), "id").dropDuplicates(["id"]).select("id", shingles("text").alias("set")))
    roots = components(leader_links(alive.join(sets.select("id", F.size("set").alias("n")), "id"), sets, similarity))
    rooted = cut(ids.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    classes = cut(rooted.groupBy("root").agg(F.min("first").alias("class_id")))
    return each.join(cut(rooted.join(classes, "root").select("id", "class_id")), "id").select("doc_id", "class_id")


@query("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    return fingerprints_with_next(table(spark, sf_dir, "documents"))
