"""Personal data: base spans against Python's plain patterns, EM against single votes, and what the classifier adds."""
import hashlib
import random
import re

import pytest

from touchline.llm import personal

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text or "") if holds(k, m.group())]


def found(spark_rows):
    return {r["doc_id"]: sorted((s["kind"], s["start"], s["end"]) for s in r["found"]) for r in spark_rows.collect()}


TEXTS = ["a@b.co x_a@b.com_y@c.de.", "a.b@c.d@e.f.g", "@b.c a@b a@-.- é%+@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1111",
         "4111111111111111 5500005555555559", "x4111111111111111y 12 34 56 78 90 12 34 5", "+1 (017) 555-7713. +44 20 7946 0958) +1-+49 30 1234567 ++1 2345 67890",
         "+1 2", "𝒳 é a@b.cd 𝒳 10.0.0.1 𝒳", "", None, "mail a@b.com, card 4111 1111 1111 1111, ip 8.8.8.8, tel +1 202 555 0100"]


def test_base_spans_equal_the_plain_patterns(make):
    r = random.Random(4)
    alphabet = "a1.2-3 4@5+(6)7%8_9é0𝒳\n"
    texts = [*TEXTS, *["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(400)], *["".join(r.choices("0123456789 -.+", k=60)) for _ in range(200)]]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"] if s["base"]] for r in personal.detect(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(plain(t)), t


def test_query_digests(spark, tmp_path, make):
    make(list(enumerate(TEXTS))).write.parquet(f"{tmp_path}/documents.parquet")
    for r in personal.op12_personal_data(spark, str(tmp_path)).collect():
        spans = plain(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in PLAIN] == [sum(s[0] == k for s in spans) for k, _ in PLAIN]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r["spans"].split(",")) | {""}


def test_the_classifier_adds_what_context_speaks_for(make):
    """National numbers beside telephone words come in, the same form beside order words does not; a number inside a base phone number stays one span."""
    r = random.Random(1)
    number = lambda: f"{r.randint(200, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}"
    account = "DE89 3704 0044 0532 0130 00"
    texts = [f"please call me, tel {number()} today" for _ in range(40)] + [f"see invoice {number().replace('-', '.')} version" for _ in range(40)]
    texts += [f"IBAN {account} bank", "write jane (at) mail (dot) com", "+1 202 555 0100", "Dear Maria Lopez, signed", "nothing here 123 456"]
    got = found(personal.detect(make(list(enumerate(texts)))))
    assert all([k for k, _, _ in got[i]] == ["local"] for i in range(40))
    assert sum(bool(got[i]) for i in range(40, 80)) == 0
    assert [k for k, _, _ in got[80]] == ["iban"] and texts[80][slice(*got[80][0][1:])] == account
    assert [k for k, _, _ in got[82]] == ["phone"] and got[84] == []


def test_em_counts_equal_single_spans_and_finds_reliable_labelers():
    r = random.Random(2)
    spans = []
    for _ in range(3000):
        true = r.random() < 0.4
        right = [0.95, 0.85, 0.7, 0.9, 0.6, 0.8]
        spans.append((true, tuple((1 if true == (r.random() < p) else -1) if r.random() < 0.8 else 0 for p in right)))
    counts = {}
    for _, v in spans:
        counts["ssn", v] = counts.get(("ssn", v), 0) + 1
    got = personal.reliabilities(counts)
    assert sum((got["ssn", v] >= 0.5) == t for t, v in spans) / len(spans) > 0.93
    double = personal.reliabilities({k: 2 * n for k, n in counts.items()})
    assert max(abs(got[k] - double[k]) for k in got) < 0.05
    assert personal.reliabilities({("ip", (1, 0, 0, 0, 0, 0)): 1})


@pytest.mark.parametrize("unit, times, each", [("a", 300_000, None), ("1", 300_000, None), ("1 ", 150_000, None), ("a@", 100_000, None), ("x@y.zz ", 30_000, ("email", 0, 6)),
                                               ("1.", 40_000, None), ("+1 ", 50_000, None), ("1.2.3.4 ", 20_000, ("ip", 0, 7))])
def test_very_long_texts(make, unit, times, each):
    """Runs that make plain backtracking quadratic."""
    got = personal.detect(make([(1, unit * times)])).collect()[0]["found"]
    base = [(s["kind"], s["start"], s["end"]) for s in got if s["base"]]
    if each:
        assert base == [(each[0], i * len(unit) + each[1], i * len(unit) + each[2]) for i in range(times)]
    elif unit == "1.":
        assert base == [("ip", 8 * i, 8 * i + 7) for i in range(times // 4)]
    else:
        assert base == []


def test_a_long_domain(make):
    text = "a@b" + ".c" * 100_000
    assert [(s["start"], s["end"]) for s in personal.detect(make([(1, text)])).collect()[0]["found"]] == [(0, len(text))]


def test_edges(make):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (1, "other 1.1.1.1"), (None, "a@b.co"), (None, None), (2, "")]
    got = [(r["doc_id"], [s["kind"] for s in r["found"]]) for r in personal.detect(make(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, ["email"]), (1, ["email"]), (1, ["ip"]), (None, ["email"]), (None, []), (2, [])], key=str)
    assert personal.detect(make([])).collect() == []
