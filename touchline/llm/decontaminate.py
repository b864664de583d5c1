"""Benchmark decontamination: CGK embedding of text windows, bit-sampling LSH against the items, exact edit verification.

Texts are word sequences (runs of letters, digits and _, lower-cased), and edits are of words. The CGK walk reads a window with a pointer: at step j it
emits the word under the pointer, then moves on or stays by a random bit of (j, word). Two windows a few edits apart emit the same words at most steps, so
edit distance becomes Hamming distance, and a key of a few sampled steps is equal for near windows with good probability. Keys are repeated with fresh bits and samples.
Every word of a text begins a window and every word of an item a probe, so an edited passage has many chances; a match gives the place to verify.
Windows are of a few words whatever the item's length, so walks alone miss some passages, short ones most. Each item is therefore also looked up by pieces: with e edits
allowed, one of e + 1 consecutive pieces of its words is unchanged in any match (4 words from 16 words on). That finds every match; short items have nothing else.
"""
from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import table
from touchline.llm.registry import query

SIMILARITY = 0.8
#: Walks: steps of each, sampled steps of each, repetitions. Items of fewer words are looked up by exact pieces alone.
STEPS, SAMPLED, REPEATS, SHORT = 11, 4, 3, 18
#: A key must rest on so many different words of the window.
PLACES = 4
#: Item words per block; a block of items and its keys is what each task holds, however many items there are.
BLOCK_WORDS = 500_000
SLICE, CODES = 1 << 17, 1_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Walk(NamedTuple):
    seed: np.uint64  # 0: the pointer always moves on
    steps: int
    sampled: tuple[int, ...]


def walks(repeats: int = REPEATS) -> list[Walk]:
    """The same walks everywhere: seeded draws. Sampled steps keep two steps apart and begin at once, so keys stay local."""
    rng, out = np.random.default_rng(8), []
    while len(out) < repeats:
        s = sorted(rng.choice(np.arange(1, STEPS), SAMPLED - 1, replace=False).tolist())
        if all(b - a >= 2 for a, b in zip([0, *s], s)):
            out.append(Walk(rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1), s[-1] + 1, (0, *s)))
    return out


def piece_walk(words: int) -> Walk:
    """Reads so many consecutive words."""
    return Walk(np.uint64(0), words, tuple(range(words)))


def walk_keys(codes: np.ndarray, starts: int, walk: Walk) -> tuple[np.ndarray, np.ndarray]:
    """Key of the window at each of the first `starts` places, and the last place the walk has read; key 0 if it rests on too few places.

    codes must go on for walk.steps places behind the last start.
    """
    at = np.arange(starts, dtype=np.int64)
    bits = (codes * walk.seed) >> np.uint64(32) if walk.seed else None
    key, places, last = np.full(starts, walk.steps, np.uint64), np.ones(starts, np.int8), at.copy()
    for j in range(walk.steps):
        if j in walk.sampled:
            key = (key ^ codes[at]) * _MIX
            key ^= key >> np.uint64(29)
            if walk.seed and j:
                places += at > last
            last = at.copy()
        at = at + (((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64) if walk.seed else 1)
    if walk.seed:
        key[places < PLACES] = 0
    return key, last


class _Codes(dict):
    """Words to 64-bit hashes, remembered within a worker."""

    def __missing__(self, word):
        self[word] = code = xxhash.xxh64_intdigest(word) or 1
        return code


_codes = _Codes()


def word_codes(text: str | None) -> np.ndarray:
    if len(_codes) > CODES:
        _codes.clear()
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    """Most word edits of an item of so many words."""
    return int((1 - similarity) * words + 1e-9)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least number of word edits between the item and any stretch of the text, and where the best stretch ends (Myers' bit-parallel matching)."""
    n, where = len(item), {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text.tolist()):
        eq = where.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(diag | up) & full), up & diag
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(diag | plus) & full), plus & diag
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Probes of a block of items: sorted keys per walk, each with its item and the place of the window in it."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS):
        self.similarity = similarity
        self.items = [(i, c) for i, c in ((i, word_codes(t)) for i, t in items) if len(c)]
        groups: dict[Walk, list[int]] = {}
        for k, (_, c) in enumerate(self.items):
            pieces = allowed(len(c), similarity) + 1
            for w in [*(walks(repeats) if len(c) >= SHORT else []), piece_walk(max(1, len(c) // pieces))]:
                groups.setdefault(w, []).append(k)
        self.probes = [(w, *self._of(w, ks)) for w, ks in groups.items()]
        self.pad = max((w.steps for w in groups), default=0) + 1

    def _of(self, walk: Walk, ks: list[int]):
        found = []
        for k in ks:
            c = self.items[k][1]
            keys, last = walk_keys(np.append(c, np.zeros(walk.steps + 1, np.uint64)), len(c), walk)
            ok = np.flatnonzero((last < len(c)) & (keys != 0))
            found.append(np.column_stack([keys[ok], np.full(len(ok), k, np.uint64), ok.astype(np.uint64)]))
        every = np.unique(np.concatenate(found), axis=0)
        filled = np.zeros(1 << 20, bool)
        filled[(every[:, 0] >> np.uint64(44)).astype(np.int64)] = True
        return filled, every[:, 0].copy(), every[:, 1].astype(np.int64), every[:, 2].astype(np.int64)

    def places(self, codes: np.ndarray, starts: int):
        """(place in codes, item, place in the item) of all equal keys among the first `starts` places."""
        for walk, filled, keys, item, offset in self.probes:
            mine, _ = walk_keys(codes[: starts + walk.steps + 1], starts, walk)
            at = np.flatnonzero(filled[(mine >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(keys, mine[at], "left"), np.searchsorted(keys, mine[at], "right")
            many = high - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            probe = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(at, many), item[probe], offset[probe]

    def search(self, texts: list[np.ndarray]):
        """(text number, item number, edits, end word) of the best verified match of each pair."""
        pad = np.zeros(self.pad, np.uint64)
        codes = np.concatenate([x for t in texts for x in (t, pad)] + [pad]) if texts else pad
        first = np.cumsum([0] + [len(t) + self.pad for t in texts])
        seen, best = set(), {}
        for base in range(0, int(first[-1]), SLICE):
            starts = min(SLICE, int(first[-1]) - base)
            for at, item, offset in self.places(codes[base: base + starts + self.pad], starts):
                doc = np.searchsorted(first, at + base, "right") - 1
                begin = at + base - first[doc] - offset
                for d, k, b in np.unique(np.column_stack([doc, item, begin]), axis=0).tolist():
                    if (d, k, b) in seen:
                        continue
                    words = self.items[k][1]
                    most = allowed(len(words), self.similarity)
                    seen.update((d, k, x) for x in range(b - 1, b + 2))
                    low = max(0, b - 2 * most - 1)
                    edits, end = distance(words, texts[d][low: max(0, b) + len(words) + 2 * most + 1])
                    if edits <= most and (d, k) not in best or edits < best.get((d, k), (0, 0))[0]:
                        best[d, k] = edits, low + end
        for (d, k), (edits, end) in sorted(best.items()):
            yield d, k, edits, end


def blocks(items: DataFrame, words: int = BLOCK_WORDS) -> list[list[tuple[int, str]]]:
    """The items in lists of about so many words. Null or empty texts are left out; repeated items stay apart by item_id."""
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // words))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r[0], r[1]) for r in items.where(slot == k).sort("item_id", "text").collect()] for k in range(n)] if total else []


def _batches(index: Index, texts):
    """Texts in runs of bounded total length, as (numbers, codes)."""
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        run.append(word_codes(t))
        size += len(run[-1])
        if size >= SLICE:
            yield at, run
            run, size, at = [], 0, i + 1
    if run:
        yield at, run


def hits(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, similarity, end_word): the items a document contains with at most (1 - similarity) * words word edits.

    One row per row of docs and item, at its best place. Items go in blocks of bounded size; each block is one pass over the whole texts and nothing is
    shuffled. Clean, null and empty texts have no row. The pieces miss no match, and precision is exact.
    """
    out = None
    for block in blocks(items):
        one = docs.select("doc_id", "text").mapInPandas(_search(block, similarity), "doc_id long, item_id long, edits int, similarity double, end_word long")
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, similarity double, end_word long") if out is None else out


def _search(block, similarity):
    def run(batches):
        index = Index(block, similarity)
        for b in batches:
            ids = b["doc_id"]
            for at, texts in _batches(index, b["text"]):
                rows = [(None if pd.isna(ids[at + d]) else int(ids[at + d]), index.items[k][0], e, 1 - e / len(index.items[k][1]), end) for d, k, e, end in index.search(texts)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "similarity", "end_word"]).astype({"doc_id": "Int64"})
    return run


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; null and empty texts are clean. No shuffle."""
    for block in blocks(items):
        docs = docs.where(_free(block, similarity)(F.col("text")))
    return docs


def _free(block, similarity):
    @F.pandas_udf("boolean")
    def free(parts: pd.Series) -> pd.Series:
        index, out = Index(block, similarity), np.ones(len(parts), bool)
        for at, texts in _batches(index, parts):
            for d, *_ in index.search(texts):
                out[at + d] = False
        return pd.Series(out)
    return free


@query("op8_decontaminate")
def op8_decontaminate(spark, sf_dir):
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
