"""Secret scan through a trigram index: Boolean trigram queries derived from the rules, postings intersected, candidates verified.

Only DataFrame functions run on the rows; the driver reads the few rule patterns.
"""
from __future__ import annotations

import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import let, running_sums, table
from touchline.llm.registry import query


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group; shorter matches are dropped


#: The three base kinds in their order. `{24,}` and `{16,}` find what the plain runs of that length find.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public token formats that the base kinds may miss.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z]+://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + MORE
MOST_STRINGS = 64


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _cross(left: list[str] | None, right: list[str] | None) -> list[str] | None:
    if left is None or right is None or len(left) * len(right) > MOST_STRINGS:
        return None
    return [a + b for a in left for b in right]


def _exact(node) -> list[str] | None:
    """All strings (lower case) a parsed element can match, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(arg).lower()]
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return sorted({chr(v).lower() for _, v in arg})
    if op == "SUBPATTERN":
        return _exact_run(arg[3])
    if op == "BRANCH":
        found = [_exact_run(x) for x in arg[1]]
        return None if any(x is None for x in found) else sorted({s for x in found for s in x})
    if op == "MAX_REPEAT":
        low, high, body = arg
        one = _exact_run(body)
        if one is None or high == parser.MAXREPEAT or high > 4:
            return None
        every, run = ([""] if low == 0 else []), [""]
        for n in range(1, high + 1):
            run = _cross(run, one)
            if run is None:
                return None
            every += run if n >= low else []
        return sorted(set(every))
    return None


def _exact_run(nodes) -> list[str] | None:
    out = [""]
    for n in nodes:
        out = _cross(out, _exact(n))
    return out


def _either(strings: list[str]) -> list[frozenset[str]]:
    """A list of gram sets, one of which any text with one of the strings has in full; [empty set]: no condition."""
    if any(len(s) < 3 for s in strings):
        return [frozenset()]
    sets = {_grams(s) for s in strings}
    return sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)


def _all(parts: list[list[frozenset[str]]]) -> list[frozenset[str]]:
    """All parts must hold. A part without condition is left out; the product stays small or the weakest parts are left out, which only admits more."""
    out = [frozenset()]
    for p in sorted((p for p in parts if p != [frozenset()]), key=len):
        if len(out) * len(p) <= MOST_STRINGS:
            out = sorted({a | b for a in out for b in p}, key=sorted)
    return out


def _needs(nodes) -> list[frozenset[str]]:
    parts, run = [], [""]
    for n in nodes:
        nxt = _exact(n)
        longer = _cross(run, nxt)
        if longer is not None:
            run = longer
            continue
        parts.append(_either(run))
        run = nxt if nxt is not None else [""]
        if nxt is None:
            op, arg = str(n[0]), n[1]
            if op == "SUBPATTERN":
                parts.append(_needs(arg[3]))
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                parts.append(_needs(arg[2]))
            elif op == "BRANCH":
                found = [_needs(x) for x in arg[1]]
                parts.append([frozenset()] if any(x == [frozenset()] for x in found) else [s for x in found for s in x])
    return _all([*parts, _either(run)])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern as an OR of ANDs of lower-case trigrams: whatever matches contains all trigrams of one set.

    [empty set] means that no trigram is mandatory, so the rule scans every text.
    """
    return _needs(parser.parse(pattern))


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as rows (gram, key): which documents contain a trigram, letters in lower case. Texts are read once and not shuffled."""
    low = docs.select(F.col(key).alias("_k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    held = F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("_k", F.explode(F.array_compact(held)).alias("gram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds array): for each document the rules whose trigram query it satisfies; rules without mandatory trigrams are not listed."""
    terms = [(r.kind, c, g, len(s)) for r in rules for c, s in enumerate(trigram_query(r.pattern)) for g in sorted(s)]
    grams = sorted({g for _, _, g, _ in terms})
    wanted = F.create_map(*[x for g in grams for x in (
        F.lit(g), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(i).alias("bit"), F.lit(n).alias("need"))
                            for k, c, i, n in _placed(terms, g)]))])
    hits = postings(docs, grams, key, text).select("_k", F.explode(wanted[F.col("gram")]).alias("t"))
    met = (hits.groupBy("_k", "t.kind", "t.clause").agg(F.bit_or(F.expr("shiftleft(1L, t.bit)")).alias("have"), F.max("t.need").alias("need"))
           .where("bit_count(have) = need"))
    return met.groupBy("_k").agg(F.collect_set("kind").alias("kinds"))


def _placed(terms, gram):
    """Terms of a trigram with its place among the sorted trigrams of its clause."""
    for kind, clause, g, n in terms:
        if g == gram:
            order = [x for k, c, x, _ in terms if (k, c) == (kind, clause)]
            yield kind, clause, order.index(g), n


def _spans(rule: Rule, order: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points, end exclusive."""
    pat = F.lit(rule.pattern)

    def placed(found, kept, gaps):
        ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))), kept, lambda s, k: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), F.length(k).alias("n")))

    def with_groups(found, gaps):
        return let(F.regexp_extract_all("_text", pat, F.lit(rule.group)), lambda kept: placed(found, kept, gaps)) if rule.group else placed(found, found, gaps)

    spans = let(F.regexp_extract_all("_text", pat, F.lit(0)), lambda found: let(F.split("_text", rule.pattern, -1), lambda gaps: with_groups(found, gaps)))
    return F.filter(spans, lambda s: s["n"] >= rule.least)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES, extra: list[str] = ()) -> DataFrame:
    """All spans per row: (doc_id, text, found array<struct<start, order, end, kind, n>>), and the columns named in extra.

    docs needs doc_id and text; other columns are not read. A null text counts as empty. The candidate list is keyed by doc_id, null
    included; repeated rows and rows sharing a doc_id each get their own spans, since a candidate is only a permission to verify.
    Rules without mandatory trigrams (runs of hex digits) scan every text. An empty table gives no rows.
    """
    asked = {r.kind for r in rules if trigram_query(r.pattern) != [frozenset()]}
    rows = docs.select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("_text"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,n:int>>")
    if asked:
        cand = candidates(docs, [r for r in rules if r.kind in asked])
        rows = rows.join(cand, rows["doc_id"].eqNullSafe(cand["_k"]), "left").drop("_k")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    found = [F.when(F.array_contains("kinds", r.kind), _spans(r, i)).otherwise(none) if r.kind in asked
             else F.when(F.regexp_like("_text", F.lit(r.pattern)), _spans(r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select("doc_id", *extra, F.col("_text").alias("text"), F.concat(*[F.coalesce(f, none) for f in found]).alias("found"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of the text replaced by the mark, overlapping spans by one; a null text stays null. n_chars, where there is one, follows the text.

    The candidates are joined to the rows, which keep all their columns; a text without secrets is unchanged.
    """
    kept = [c for c in docs.columns if c != "text"]
    rows = scan(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), rules, extra=["_row"])
    spans = F.array_sort("found")
    clean = F.aggregate(spans, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"] + 1).alias("at"),
        F.when(s["start"] + 1 >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"], s["start"] + 1 - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"], F.length("text"))))
    text = F.when(F.size("found") == 0, F.col("_row.text")).otherwise(clean)
    out = rows.select(*[F.col(f"_row.{c}").alias(c) for c in kept], text.alias("text"))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *[_count(r.kind) for r in BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
