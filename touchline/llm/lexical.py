"""Ranked lexical search by NRA: impact-sorted lists are read in turn, score intervals kept per document until the best k are settled."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import scratch, table, width
from touchline.llm.registry import query

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_ROWS = 1_500_000  # postings in one task
SMALL_SHARD = 100_000  # below this a task is not worth its start
ITEM_BLOCK = 4096  # items that a task ranks at a time
ALL = -1  # term id of the entry that every document has


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included: runs of digits, ASCII letters and all characters beyond ASCII; only A-Z lower-cased, null empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1), lambda t: t != "")


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (row, doc_id, n, tid, tf) of the terms of vocabulary (term, tid), and one of term ALL for each document; n counts all its terms.

    Each row of docs is a document of its own, told apart by `row`, repeated and null ids included. Spark broadcasts the vocabulary by its own size
    estimate, else joins by term; the counts are combined before the shuffle.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", terms(F.col("text")).alias("_terms"))
    each = rows.select("row", "doc_id", F.size("_terms").cast("long").alias("n"), F.explode(F.concat("_terms", F.array(F.lit("")))).alias("term"))
    known = vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(ALL).cast("long").alias("tid")))
    return each.join(known, "term").groupBy("row", "doc_id", "n", "tid").agg(F.count(F.lit(1)).alias("tf"))


def rank(docs: DataFrame, items: DataFrame, k: int = 50, shard_rows: int = SHARD_ROWS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """For each row of items (item_id, text) the k best documents of docs (doc_id, text) as (item_id, rank, doc_id, score).

    Whole texts are read, other columns are not. Rank is from 1, highest score first, equal scores by ascending doc_id (null first), then in the order of the
    rows. Documents with score 0 are left out, so an item without terms, or whose terms no document holds, has no rows; so has an empty table. Items that share an
    id are ranked each for itself.

    Statistics are counted over all documents. The postings of the items' terms are then cut into shards of documents; a task holds one shard's lists sorted by
    impact, and ranks a block of items by NRA (see nra). The k best of all shards are merged by rank.
    """
    spark = docs.sparkSession
    asked = _written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_distinct(terms(F.col("text"))).alias("_terms"))
                     .select("item", "item_id", F.explode("_terms").alias("term")), "items")
    vocabulary = _written(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    held = _written(index(docs, vocabulary), "postings")
    whole = held.where(F.col("tid") == ALL).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["terms"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log(F.lit(2.0 * whole["docs"] + 2) / (2 * F.col("df") + 1)))
    weights = held.where(F.col("tid") != ALL).groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", weight.alias("w")).where("w > 0")
    weights = _written(weights, "weights")
    m = 50 + F.expr(f"(50L * n * {whole['docs']}L) div {whole['terms']}L")
    impact = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    lists = held.withColumn("m", m).join(weights, "tid").select("row", "doc_id", "tid", impact.alias("impact")).where("impact > 0")

    counts = weights.join(held.groupBy("tid").agg(F.count(F.lit(1)).alias("c")), "tid").agg(F.sum("c").alias("c")).first()["c"] or 0
    shards = max(-(-counts // shard_rows), min(width(spark), -(-counts // SMALL_SHARD)), 1)
    blocks = -(-asked.select("item").distinct().count() // item_block) or 1
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    wanted = (asked.join(vocabulary, "term").join(weights.select("tid"), "tid").select("item", "tid", block.alias("block"))
              .select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))
    placed = lists.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(items_of: pa.Table, postings: pa.Table) -> pa.Table:
        return _rank_shard(items_of, postings, k)

    local = (wanted.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block"))
             .applyInArrow(best, "item long, row long, doc_id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rank_shard(items: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """The k best documents of a shard for every item; lists are sorted by impact once."""
    out = {c: [] for c in ("item", "row", "place", "score")}
    row, ids = postings["row"].to_numpy(), postings["doc_id"].combine_chunks()
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    rows, one, doc = np.unique(row, return_index=True, return_inverse=True)
    order = np.lexsort((rows, number[one], ~empty[one]))  # documents in the order of ties
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    doc, tid, impact = place[doc], postings["tid"].to_numpy(), postings["impact"].to_numpy()
    by = np.lexsort((doc, -impact, tid))
    doc, tid, impact = doc[by], tid[by], impact[by]
    known, start = np.unique(tid, return_index=True)
    end = np.append(start[1:], tid.size)
    lists = {t: (doc[a:b], impact[a:b]) for t, a, b in zip(known.tolist(), start.tolist(), end.tolist())}
    item, term = items["item"].to_numpy(), items["tid"].to_numpy()
    by = np.argsort(item, kind="stable")
    names, first = np.unique(item[by], return_index=True)
    for name, own in zip(names.tolist(), np.split(term[by], first[1:])):
        at, score = nra([lists[t] for t in own.tolist() if t in lists], order.size, k)
        out["item"].append(np.full(at.size, name, np.int64))
        out["place"].append(at)
        out["score"].append(score)
    joined = {c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in out.items()}
    back = order[joined["place"]]
    return pa.table({"item": joined["item"], "row": rows[back], "doc_id": pa.array(number[one][back], mask=empty[one][back]), "score": joined["score"]},
                    schema=pa.schema([("item", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of `docs` documents, by score and then number, without random access: (numbers, scores).

    A list holds documents and their impacts, highest first. In each round all lists are read down to a common impact, half of the highest one unread.
    A document's lower bound is what was read of it; its upper bound adds the next unread impact of each list in which it was not met. Once an unmet document can no
    longer reach the k-th lower bound, only those that can are followed, and dropped when their upper bound falls below it. Reading ends when nothing
    is unread, or the bounds of all that are left agree: then membership, ties and scores are settled.
    """
    lists = [x for x in lists if x[0].size]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.zeros(docs, np.int64)
    met = np.zeros((len(lists), docs), bool)
    at = [0] * len(lists)
    front = np.array([imp[0] for _, imp in lists], np.int64)
    alive, inside = None, None
    while front.any():
        down_to = max(int(front.max()) // 2, 1)
        for t, (doc, imp) in enumerate(lists):
            if front[t] < down_to:
                continue
            upto = imp.size - int(np.searchsorted(imp[::-1], down_to))
            new, gain = doc[at[t]:upto], imp[at[t]:upto]
            if inside is not None:
                keep = inside[new]
                new, gain = new[keep], gain[keep]
            low[new] += gain
            met[t, new] = True
            at[t] = upto
            front[t] = imp[upto] if upto < imp.size else 0
        least = int(np.partition(low, docs - k)[docs - k]) if docs >= k else 0
        if alive is None:
            if least <= int(front.sum()):
                continue
            alive = np.flatnonzero(low)
        high = low[alive] + front @ ~met[:, alive]
        stay = high >= least
        alive, high = alive[stay], high[stay]
        if (high == low[alive]).all():
            break
        inside = np.zeros(docs, bool)
        inside[alive] = True
    if alive is None:
        alive = np.flatnonzero(low)
    best = alive[np.lexsort((alive, -low[alive]))][:k]
    return best, low[best]


SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
asked AS (SELECT row_number() OVER () AS i, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS ts FROM benchmark),
wanted AS (SELECT i, item_id, unnest(ts) AS term FROM asked),
whole AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM texts WHERE len(ts) > 0),
each AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM texts),
post AS (SELECT r, doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, whole GROUP BY term),
scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM wanted JOIN post USING (term) JOIN weight USING (term), whole GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 50
""".replace("{upper}", UPPER).replace("{lower}", LOWER)


@query("op13_ranked_search", SQL)
def op13_ranked_search(spark, sf_dir):
    """The 50 best documents of every benchmark item; nulls, empty texts, ties and repeated rows as in `rank`."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
