"""Personal data by weak supervision: regex, gazetteer and context labelers vote on spans, EM weighs them, a span classifier learns from the result.

Only DataFrame functions run on the rows. The driver sees vote patterns and their counts, at most 3 to the number of labelers for each kind.
"""
from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import let, running_sums, table
from touchline.llm.registry import query
from touchline.session import cut


class Kind(NamedTuple):
    name: str
    pattern: str
    base: bool
    cues: str  # words near a span that speak for it


#: Possessive quantifiers and run starts keep each pattern linear in the text; they find what the plain patterns find. `\G` is the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Given names of the gazetteer.
NAMES = ("Alice Anna Antonio Carlos Charles Daniel David Elena Elizabeth Emma Francisco Hans Isabel James Jean John Jose Juan Karl Laura Linda Lucia Luis Maria "
         "Marie Martin Mary Michael Michel Patricia Paul Peter Pierre Robert Sarah Sofia Stefan Susan Thomas William").split()
KINDS = (
    Kind("email", EMAIL, True, "e-?mail|contact|write|reach|correo|courriel|kontakt"),
    Kind("ip", IP, True, "ip|host|server|address|client|login|adresse"),
    Kind("card", CARD, True, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"),
    Kind("phone", PHONE, True, "phone|tel|call|mobile|cell|fax|whatsapp|telefon"),
    Kind("masked", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++", False,
         "e-?mail|contact|write|reach|correo|courriel|kontakt"),
    Kind("local", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", False, "phone|tel|call|mobile|cell|fax|whatsapp|telefon"),
    Kind("ssn", r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", False, "ssn|social security|taxpayer|tax id"),
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", False, "iban|account|bank|konto|compte|cuenta"),
    Kind("person", rf"(?<![A-Za-z])(?:{'|'.join(NAMES)})\x20[A-Z][a-z]++(?![A-Za-z])", False, "mr|mrs|ms|dr|name|dear|sincerely|regards|patient|signed"),
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Domains, dialling codes and account countries of the gazetteers, and words that speak of other numbers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu"
DIALLING = "1|7|20|27|30|31|32|33|34|39|41|43|44|45|46|47|48|49|52|55|61|81|82|86|90|91"
BANKS = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
OTHER = "order|invoice|version|build|isbn|sku|serial|part no|lot|ref|ticket|model|rev"
LABELERS = 6
BEFORE, AFTER = 48, 24  # characters of context
BUCKETS = 4096  # weights of the span classifier
ROUNDS = 50
SPAN = "start int, order int, end int, kind string, value string, base boolean, probability double"
CANDIDATE = "array<struct<start:int,order:int,end:int,kind:string,value:string,base:boolean,votes:string,features:array<int>>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a base kind holds; other matches are dropped without another try."""
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """Remainder of an account number by 97: its first four characters go to the end, letters count from 10."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substr(turned, i, F.lit(1)))), F.lit(0),
                       lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97)


def _near(text: Column, words: str) -> Column:
    return F.regexp_like(text, F.lit(rf"(?i)(?<![a-z])(?:{words})(?![a-z])"))


def _votes(kind: Kind, value: Column, before: Column, after: Column) -> list[Column]:
    """Votes of the labelers on a span: 1 for, -1 against, 0 none."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    no = lambda c: F.when(c, -1).otherwise(0)
    either = lambda c: F.when(c, 1).otherwise(-1)
    digits = _digits(value)
    form = {"masked": either(F.regexp_like(value, F.lit(r"[A-Za-z]{2,6}$"))), "local": either(F.regexp_like(value, F.lit(r"^\(?[2-9]"))),
            "ssn": either(~F.regexp_like(value, F.lit(r"^(?:000|666|9)|-00-|-0000$"))), "iban": either(_mod97(value) == 1),
            "ip": no(F.regexp_like(value, F.lit(r"^0|\.0[0-9]"))), "person": F.lit(0)}.get(kind.name, F.lit(1))
    known = {"email": yes(F.regexp_like(value, F.lit(rf"(?i)\.(?:{DOMAINS})$"))), "masked": yes(F.regexp_like(value, F.lit(rf"(?i)[\])]\x20?(?:{DOMAINS})$"))),
             "ip": no(F.regexp_like(value, F.lit(r"^(?:0|10|127|192\.168|255)\."))), "card": yes(F.regexp_like(digits, F.lit("^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"))),
             "phone": yes(F.regexp_like(value, F.lit(rf"^\+(?:{DIALLING})(?![0-9]{{12}})"))), "iban": either(F.regexp_like(value, F.lit(rf"^(?:{BANKS})"))),
             "person": F.lit(1)}.get(kind.name, F.lit(0))
    run = F.regexp_like(digits, F.lit(r"^(?:([0-9])\1*|0?123456789[0-9]*|9876543210?[0-9]*)$"))
    return [form, known, yes(_near(before, kind.cues) | _near(after, kind.cues)), no(_near(before, OTHER)),
            no(F.regexp_like(before, F.lit("[A-Za-z0-9]$")) | F.regexp_like(after, F.lit("^[A-Za-z0-9]"))), no((digits != "") & run)]


def _features(kind: Kind, value: Column, before: Column, after: Column) -> Column:
    """Hashed features of a span: its shape and length, the two words before it and the one after."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    words = F.filter(F.split(F.lower(before), r"[^\p{L}0-9]+"), lambda w: w != "")
    word = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    named = [("shape", shape), ("length", F.length(value).cast("string")), ("one", word(-1)), ("two", word(-2)),
             ("next", F.regexp_extract(F.lower(after), r"^[^\p{L}0-9]*([\p{L}0-9]*)", 1))]
    return F.array(*[F.pmod(F.xxhash64(F.lit(f"{kind.name}:{n}"), v), F.lit(BUCKETS)).cast("int") for n, v in named])


def _spans(order: int, kind: Kind) -> Column:
    """Spans of a kind's leftmost non-overlapping matches with votes and features. Context reaches to the kind's next match at most, so long texts stay linear."""
    pattern = F.lit(kind.pattern)

    def placed(found, gaps):
        ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
        near = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.right(g, F.lit(BEFORE))),
                          F.transform(F.slice(gaps, F.lit(2), F.size(found)), lambda g: F.left(g, F.lit(AFTER))), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        return F.zip_with(F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"))), near, lambda s, c: F.struct(
            s["m"].alias("m"), s["e"].alias("e"), c["b"].alias("b"), c["a"].alias("a")))

    def made(s):
        return F.struct((s["e"] - F.length(s["m"])).alias("start"), F.lit(order).alias("order"), s["e"].alias("end"), F.lit(kind.name).alias("kind"), s["m"].alias("value"),
                        F.lit(kind.base).alias("base"), F.concat_ws(",", *[v.cast("string") for v in _votes(kind, s["m"], s["b"], s["a"])]).alias("votes"),
                        _features(kind, s["m"], s["b"], s["a"]).alias("features"))

    spans = let(F.regexp_extract_all("_text", pattern, F.lit(0)), lambda found: let(F.split("_text", kind.pattern, -1), lambda gaps: placed(found, gaps)))
    held = F.filter(spans, lambda s: _valid(kind.name, s["m"]) if kind.base else ~F.regexp_like(s["b"], F.lit(r"\+[0-9][\x20().0-9-]*$")))
    return F.when(F.regexp_like("_text", pattern), F.transform(held, made).cast(CANDIDATE)).otherwise(F.array().cast(CANDIDATE))


def candidates(docs: DataFrame, extra: list[str] = (), kinds=KINDS) -> DataFrame:
    """(doc_id, extra columns, found): per row the spans of all kinds with their votes and features. One pass over the texts, no shuffle."""
    rows = docs.select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("_text"))
    return rows.select("doc_id", *extra, F.concat(*[_spans(i, k) for i, k in enumerate(kinds)]).alias("found"))


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """EM over vote patterns (kind, votes) with their counts: the probability that a span with the pattern is personal data.

    Hidden is whether a span is personal data, with a prior for each kind; each labeler has a chance of each vote in either case. Labelers start as better than chance; a
    weak prior, worth a few spans, keeps chances off 0 and 1, so kinds and votes seen once are defined.
    """
    kinds = sorted({k for k, _ in counts})
    right = {(1, 1): 3.0, (1, 0): 2.0, (1, -1): 0.5, (0, 1): 0.5, (0, 0): 2.0, (0, -1): 3.0}  # pseudo-counts (personal, vote)
    chance = [{(c, v): right[c, v] / sum(right[c, x] for x in (1, 0, -1)) for c in (0, 1) for v in (1, 0, -1)} for _ in range(LABELERS)]
    prior = {k: 0.5 for k in kinds}
    out: dict = {}
    for _ in range(rounds):
        for (kind, votes) in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[j][1, v] / chance[j][0, v]) for j, v in enumerate(votes))
            out[kind, votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for kind in kinds:
            own = [(out[p], n) for p, n in counts.items() if p[0] == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j in range(LABELERS):
            mass = dict(right)
            for (kind, votes), n in counts.items():
                p = out[kind, votes]
                mass[1, votes[j]] += p * n
                mass[0, votes[j]] += (1 - p) * n
            chance[j] = {(c, v): mass[c, v] / sum(mass[c, x] for x in (1, 0, -1)) for c in (0, 1) for v in (1, 0, -1)}
    return out


class Model(NamedTuple):
    prior: dict[str, float]  # log odds of each kind
    weight: list[float]  # log ratio of each feature bucket


def learn(found: DataFrame) -> Model:
    """The span classifier from candidates: naive Bayes over the hashed features, with the EM probabilities as soft labels.

    Counts are sums over all spans, combined before the shuffle; the result has one weight a bucket. No spans: all weights are 0.
    """
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    counts = {(r["kind"], tuple(map(int, r["votes"].split(",")))): r["n"] for r in spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, [0.0] * BUCKETS)
    chance = reliabilities(counts)
    listed = json.dumps([{"kind": k, "votes": ",".join(map(str, v)), "p": p} for (k, v), p in sorted(chance.items())])
    known = found.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<kind:string,votes:string,p:double>>")))
    soft = spans.join(known, ["kind", "votes"]).select("p", F.explode("features").alias("f"))
    sums = {r["f"]: (r["yes"], r["no"]) for r in soft.groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    yes, no = (sum(x[i] for x in sums.values()) for i in (0, 1))
    level = math.log((yes + 1) / (no + 1))
    weight = [0.0] * BUCKETS
    for f, (a, b) in sums.items():
        weight[f] = math.log((a + 1) / (b + 1)) - level
    prior = {}
    for kind in {k for k, _ in counts}:
        a, n = sum(chance[p] * c for p, c in counts.items() if p[0] == kind), sum(c for p, c in counts.items() if p[0] == kind)
        prior[kind] = math.log((a + 1) / (n - a + 1))
    return Model(prior, weight)


def detect(docs: DataFrame, extra: list[str] = (), kinds=KINDS) -> DataFrame:
    """(doc_id, extra columns, found array<struct<start, order, end, kind, value, base, probability>>): all personal data of every row, in code points, end exclusive.

    docs needs doc_id and text. A null text counts as empty; a row without spans has an empty array; repeated rows and rows that share an id each get their own. An empty
    table gives no rows. Spans of the base kinds are what their patterns and checks give, whatever their probability; other spans stay if the classifier gives them
    0.5 or more, and may not lie in a base phone number. The texts are read once; what is learned comes from the spans of all rows.
    """
    found = cut(candidates(docs, extra, kinds))
    model = learn(found)
    weights = F.from_json(F.lit(json.dumps(model.weight)), "array<double>")
    prior = F.from_json(F.lit(json.dumps(model.prior)), "map<string,double>")

    def scored(s):
        odds = F.coalesce(F.try_element_at(prior, s["kind"]), F.lit(0.0)) + F.aggregate(s["features"], F.lit(0.0), lambda a, f: a + F.get(weights, f))
        return F.struct(*[s[c].alias(c) for c in ("start", "order", "end", "kind", "value", "base")], (1 / (1 + F.exp(-odds))).alias("probability"))

    kept = F.filter(F.transform("found", scored), lambda s: s["base"] | (s["probability"] >= 0.5))
    return found.select("doc_id", *extra, kept.alias("found"))


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["order"].alias("o"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    """Base counts and spans of every document, and all spans; nulls, empty texts and repeated rows as in `detect`."""
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    counts = [_count(k.name) for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
