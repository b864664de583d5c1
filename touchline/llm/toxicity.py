"""Toxicity scores: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, table, tidy
from touchline.llm.registry import query

#: Insults to start from; their weights are learned, and words that the labels show are added.
SEEDS = """idiot idiots idiotic moron morons moronic stupid trash scum loser losers clown clowns pathetic worthless disgusting imbecile scumbag
dumbass jackass asshole bastard bitch arschloch idiotisch drecksack abschaum connard imbécile crétin ordure idiota estúpido imbécil escoria asqueroso""".split()
#: Harmless phrases; a lexicon match inside one does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "rodeo clown", "class clown", "circus clown", "lost to the loser")
#: Bounds of learning: labelled rows that are looked at, words the lexicon may gain.
SAMPLE_ROWS, LEARNED_WORDS = 20_000, 200
#: Least share of the toxic texts that hold a seed, a new word, a stem; least log odds of a word (by texts) and a stem (by occurrences and by texts).
SEED_SHARE, NEW_SHARE, STEM_SHARE, LEAST_ODDS, STEM_ODDS, TEXT_ODDS, UNSEEN, MOST_WEIGHT = 0.002, 0.10, 0.03, 3.0, 2.5, 1.5, 3.0, 8.0
STEM_LENGTHS = range(4, 9)

#: Look-alike letters of other scripts.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_FOLD = {ord(k): v for k, v in {**LOOK_ALIKES, **DIGITS}.items()} | {c: None for c in [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]}
# i, l and 1 are written for each other, so folded text has one letter for them
_FOLD = {k: v.replace("i", "l") if v else v for k, v in _FOLD.items()} | {ord("i"): "l"}
_TAIL, _GAP = re.compile(r"[@$!|+]+(?![^\W_])"), re.compile(r"[^a-z]+")


def fold(text: str) -> str:
    """Letters a-z (i as l) with single spaces between and around words; accents, look-alikes, digit substitutions and hidden characters are undone.

    Signs at the end of a word are punctuation, not letters.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return " " + _GAP.sub(" ", _TAIL.sub(" ", text.lower()).translate(_FOLD)).strip() + " "


class Model(NamedTuple):
    weights: dict[str, float]  # folded word or phrase, or a stem with * at its end -> weight
    exceptions: tuple[str, ...]  # folded
    intercept: float
    by_sum: float
    by_share: float


class Scorer:
    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        for word, w in model.weights.items():
            pattern = f" {word} " if word[-1:] != "*" else f" {word[:-1]}"
            self.automaton.add_word(pattern, (len(pattern), w))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the matched weights (its logarithm), and the sum per hundred words, both without matches inside exception phrases."""
        folded = fold(text or "")
        hits = [(end - n + 1, end, w) for end, (n, w) in self.automaton.iter(folded)]
        free = [(s, e) for s, e, w in hits if w is None]
        total = sum(w for s, e, w in hits if w is not None and not any(a <= s and e <= b for a, b in free))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-(self.model.intercept + self.model.by_sum * x + self.model.by_share * y))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out: all, or if there are more than `rows` a share chosen by a hash. Labels of one doc_id count once."""
    each = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = each.count()
    if n > rows:
        each = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    found = docs.select("doc_id", "text").join(F.broadcast(each), "doc_id")  # bounded by rows
    return cut(found.select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def learn(docs: DataFrame, labels: DataFrame, seeds=SEEDS, exceptions=EXCEPTIONS, rows: int = SAMPLE_ROWS, words: int = LEARNED_WORDS) -> Model:
    """Weights and calibration from at most about `rows` labelled rows; held-out rows are never used.

    Word counts by class are a Spark aggregation; at most `words` words reach the driver, and one line of two features and the label per sampled row.
    Without labels the seeds keep a fixed weight and the calibration a fixed slope.
    """
    seed_set = sorted({fold(s).strip() for s in seeds})
    free = tuple(sorted({fold(e).strip() for e in exceptions}))
    sample = _sample(docs, labels, rows)
    texts = cut(sample.dropDuplicates(["text"]))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counts = _counts(texts, lambda ws: Counter(w for w in set(ws) if 3 <= len(w) <= 30)).withColumn("odds", _odds("bad", "good", bad, good))
    least = F.when(F.col("term").isin(seed_set), SEED_SHARE).otherwise(NEW_SHARE)
    found = counts.where((F.col("odds") >= LEAST_ODDS) & (F.col("bad_texts") >= least * bad))
    weights = {w: UNSEEN for w in seed_set} | {r["term"]: min(MOST_WEIGHT, r["odds"]) for r in found.orderBy(F.desc("odds"), "term").limit(words).collect()}
    known = frozenset(weights)
    counts = cut(_counts(texts, lambda ws: Counter(w[:k] for w in ws if w not in known for k in STEM_LENGTHS if len(w) >= k)))
    totals = counts.where(F.length("term") == STEM_LENGTHS[0]).agg(F.sum("bad"), F.sum("good")).first()
    stems = counts.withColumn("odds", _odds("bad", "good", totals[0] or 0, totals[1] or 0)).where(
        (F.col("odds") >= STEM_ODDS) & (F.col("bad_texts") >= STEM_SHARE * bad) & (_odds("bad_texts", "good_texts", bad, good) >= TEXT_ODDS))
    for r in sorted(stems.orderBy(F.desc("bad"), "term").limit(5 * words).collect(), key=lambda r: (len(r["term"]), r["term"])):
        if not any(r["term"][:k] + "*" in weights for k in STEM_LENGTHS):
            weights[r["term"] + "*"] = min(MOST_WEIGHT, r["odds"])
    model = Model(weights, free, -2.0, 2.0, 0.0)

    def features(batches):
        scorer = Scorer(model)
        for b in batches:
            yield pd.DataFrame([(*scorer.features(t), y) for t, y in zip(b["text"], b["toxic"])], columns=["x", "y", "toxic"])

    if bad and good:
        got = sample.mapInPandas(tidy(features), "x double, y double, toxic int").groupBy("x", "y", "toxic").agg(F.count("*").alias("n")).toPandas()
        model = model._replace(**dict(zip(("intercept", "by_sum", "by_share"), _logistic(got[["x", "y"]].to_numpy(), got["toxic"].to_numpy(float), got["n"].to_numpy(float)), strict=True)))
    return model


def _counts(texts: DataFrame, terms) -> DataFrame:
    """(term, bad, good, bad_texts, good_texts): how often a term occurs in toxic and other texts, and in how many; counted per batch before the shuffle."""
    def count(batches):
        for b in batches:
            by, held = (Counter(), Counter()), (Counter(), Counter())
            for text, t in zip(b["text"], b["toxic"]):
                found = terms(fold(text).split())
                by[t].update(found)
                held[t].update(found.keys())
            every = list(by[0].keys() | by[1].keys())
            if not every:
                continue
            yield pd.DataFrame({"term": every, "bad": [by[1][w] for w in every], "good": [by[0][w] for w in every],
                                "bad_texts": [held[1][w] for w in every], "good_texts": [held[0][w] for w in every]})

    names = ("bad", "good", "bad_texts", "good_texts")
    rows = texts.mapInPandas(tidy(count), "term string, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def _odds(bad: str, good: str, all_bad: int, all_good: int) -> Column:
    return F.log((F.col(bad) + 0.5) / (all_bad + 1)) - F.log((F.col(good) + 0.5) / (all_good + 1))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Intercept and two slopes by Newton steps on counted rows, until they stand still."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y, n = np.column_stack([np.ones(len(x)), x])[order], y[order], n[order]
    beta, penalty = np.zeros(3), ridge * np.diag([0, 1, 1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3), x.T @ (n * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in beta]


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the score in column `out`; every row's whole text is scored, a null text as an empty one. The other columns and all rows stay as they are."""
    def scores(batches):
        scorer = Scorer(model)
        for texts in batches:
            yield pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())  # one text at a time is a Python string

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(scores)(batches)

    return docs.withColumn(out, scored("text"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
