"""Ranked search against plain scoring of every document, and NRA on random lists."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from touchline.llm import lexical

ITEM = "item_id long, text string, term string, score string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))


def brute(docs, items, k):
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (doc, _) in enumerate(docs):
            m = 50 + 50 * n[at] * total // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[at][t] // (1000 * tf[at][t] + 20 * m)) for t in set(words(text)) if tf[at][t])
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, at))
        out += [(item, r + 1, docs[at][0], -s) for r, (s, _, _, at) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_rows, item_block", [(10**9, 4096), (60, 4096), (200, 5)])
def test_search_equals_plain_scoring(spark, make, shard_rows, item_block):
    """Zipf words, ties, repeated rows and ids, whatever the shards and blocks of items."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "数据"]
    draw = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(64)], k=n))
    docs = [(r.randint(0, 150), draw(r.randint(0, 40))) for _ in range(200)] + [(7, "W1 w2-w3"), (7, "W1 w2-w3"), (None, "w1 w2"), (None, None), (8, ""), (9, "...")]
    items = [(i, draw(r.randint(1, 12))) for i in range(20)] + [(3, "w1 W1 w5"), (90, None), (91, ""), (92, "unheard of"), (None, "w2")]
    got = lexical.rank(make(docs), spark.createDataFrame([(*x, "a", "b") for x in items], ITEM), 7, shard_rows, item_block)
    assert rows_of(got) == brute(docs, items, 7)


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b", "x", "y")], ITEM)
    assert lexical.rank(make([]), items).collect() == []
    assert lexical.rank(make([(1, None), (2, "-")]), items).collect() == []
    assert lexical.rank(make([(1, "a b")]), items.limit(0)).collect() == []


def test_a_very_long_text_and_a_word_in_every_text(spark, make):
    docs = [(i, f"the {'x' * (i % 7 + 1)} the") for i in range(300)] + [(999, "needle " + "the hay " * 200_000)]
    items = spark.createDataFrame([(1, "the needle", "a", "b"), (2, "the xxx", "a", "b")], ITEM)
    assert rows_of(lexical.rank(make(docs), items, 50, shard_rows=100)) == brute(docs, [(1, "the needle"), (2, "the xxx")], 50)


@pytest.mark.parametrize("seed", range(30))
def test_nra_settles_members_ties_and_scores(seed):
    r = np.random.default_rng(seed)
    docs, k = int(r.integers(1, 400)), int(r.integers(1, 30))
    lists, want = [], np.zeros(docs, np.int64)
    for _ in range(int(r.integers(1, 80))):
        at = r.permutation(docs)[: int(r.integers(0, docs + 1))]
        gain = r.integers(1, int(r.integers(2, 10**6)), at.size) if seed % 3 else np.full(at.size, 5)
        by = np.argsort(-gain, kind="stable")
        lists.append((at[by], gain[by]))
        want[at] += gain
    best, score = lexical.nra(lists, docs, k)
    order = np.lexsort((np.arange(docs), -want))[:k]
    order = order[want[order] > 0]
    assert best.tolist() == order.tolist() and score.tolist() == want[order].tolist()
