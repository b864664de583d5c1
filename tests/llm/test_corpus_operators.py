"""Operators across texts: fingerprints, near duplicates, decontamination, url filter, components, the pipeline."""
import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from touchline.llm import decontaminate, minhash, queries, simhash, urls
from touchline.llm.common import components, shingle_hashes


def roots(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7), (100, 101)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = roots(nodes, [x for x in links if x[0] != x[1]])
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes_equal_all_pairs(make, prose):
    base = prose(1, 400)
    rows = [(i, " ".join(w for k, w in enumerate(base.split()) if k != 7 * i)) for i in range(60)] + [(100 + i, prose(i, 5 + i)) for i in range(40)]
    rows += [(200, base), (201, base), (201, base), (300, ""), (301, None), (302, " \n"), (None, base), (400, "one"), (401, "ONE"), (402, "one two")]
    fp = {k: plain_simhash(t) for k, (_, t) in enumerate(rows)}
    root = roots(fp, [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    group = {}
    for k, r in root.items():
        group.setdefault(r, []).append(rows[k][0])
    want = sorted((str(rows[k][0]), f"{fp[k]:016x}", min(i for i in group[root[k]] if i is not None)) for k in fp)
    got = simhash.near_classes(make(rows)).collect()
    assert sorted((str(r["doc_id"]), f"{r['fp'] % 2 ** 64:016x}", r["component_id"]) for r in got) == want
    assert simhash.near_classes(make([])).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    apart = lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count()
    near = [(a, b) for a, b in combinations(signed, 2) if apart(a, b) <= 2]
    assert all(apart(r["a"], r["b"]) <= 2 for r in got)
    assert roots(signed, near) == roots(signed, [tuple(r) for r in got])


def jaccard(a, b):
    x, y = ({h for s in shingle_hashes(t, 5) for h in s.tolist()} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_near_duplicate_group_stays(make, prose):
    rng = random.Random(9)
    base, shared = [prose(100 + i, 150) for i in range(3)], prose(77, 60)
    rows = []
    for i in range(90):
        words = base[i % 3].split()
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, shared + " " + prose(900 + i, 120)) for i in range(40)]  # one passage in many documents
    rows += [(300, rows[0][1]), (301, ""), (302, None), (None, rows[0][1]), (303, "tiny text"), (303, "tiny text")]
    kept = simhash.keep_one(make(rows)).collect()
    text = dict(rows)
    ids = [r["doc_id"] for r in kept]
    assert set(range(200, 240)) <= set(ids) and ids.count(None) == 1 and ids.count(303) == 2 and 302 not in ids and 301 in ids
    left = [i for i in set(ids) if i is not None and i < 90]
    assert 300 not in ids and not [1 for a, b in combinations(left, 2) if jaccard(text[a], text[b]) >= 0.8]
    gone = set(range(90)) - set(left)
    assert gone and all(any(jaccard(text[g], t) >= 0.8 or (plain_simhash(text[g]) ^ plain_simhash(t)).bit_count() <= 2 for i, t in rows if i != g and t) for g in gone)
    assert simhash.keep_one(make([])).count() == 0


def test_short_near_copies_are_found(make, prose):
    rng, rows = random.Random(3), []
    for k, n in enumerate([8, 9, 10, 12, 15, 18, 22, 30, 40] * 14):
        words = prose(3000 + k, n).split()
        other = list(words)
        at = rng.choice([0, n - 1, rng.randrange(n)])
        if rng.random() < 0.5:
            other[at] = "edited"
        else:
            other = ["extra", *other] if at < n // 2 else [*other, "extra"]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = make(rows)
    text = dict(rows)
    want = {(b, a) for a, b in combinations(text, 2) if jaccard(text[a], text[b]) >= 0.8}
    texts = docs.select(simhash._text_id().alias("id"), F.col("doc_id").alias("first"))
    name = {r["id"]: r["first"] for r in texts.collect()}
    got = {(max(x), min(x)) for x in ((name[r["a"]], name[r["b"]]) for r in simhash.likeness_links(docs, texts).collect())}
    assert len(want) > 40 and got == want


def test_repeated_lines_do_not_part_copies(make, prose):
    rows = []
    for k in range(4):
        text, line = prose(4000 + k, 200), prose(4100 + k, 10)
        rows += [(2 * k, f"{text} {line}"), (2 * k + 1, f"{text} {' '.join([line] * 20)}")]
    text = dict(rows)
    assert all(jaccard(text[2 * k], text[2 * k + 1]) >= 0.8 for k in range(4))
    assert any((plain_simhash(text[2 * k]) ^ plain_simhash(text[2 * k + 1])).bit_count() > 20 for k in range(4))
    assert sorted(r["doc_id"] for r in simhash.keep_one(make(rows)).collect()) == [0, 2, 4, 6]


def test_chains_are_one_group_in_any_order_of_ids(make, prose):
    words, rows, chains = prose(5000, 400).split(), [], []
    for order in ((0, 1, 2, 3, 4, 5), (5, 4, 3, 2, 1, 0), (2, 0, 4, 1, 5, 3), (1, 3, 5, 0, 2, 4)):
        base = 10 * len(chains)
        window = [prose(5100 + base, 300).split()[18 * k: 18 * k + 200] for k in range(6)]
        chains.append({base + i: " ".join(window[k]) for k, i in enumerate(order)})
    for c in chains:
        assert 5 <= sum(jaccard(x, y) >= 0.8 for x, y in combinations(c.values(), 2)) < 10
        rows += c.items()
    rows += [(100 + i, " ".join(words[:60]) + " " + prose(5200 + i, 150)) for i in range(20)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(make(rows)).collect()) == [0, 10, 20, 30, *range(100, 120)]
    ids = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(make(rows)).collect()}
    assert all(ids[i] == 10 * k for k, c in enumerate(chains) for i in c)


def test_fingerprints_and_next_document(make, prose):
    rows = [(3 * i, prose(i, 3 + 9 * i)) for i in range(40)] + [(1, None), (2, ""), (4, "é" * 9), (None, "first of all"), (6, "x y z " * 50_000), (9, "tie b"), (9, "tie a"), (9, "tie a")]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        want.append((i, t, nxt, t[:len(t) - n] + nxt[:n]))
    got = minhash.fingerprints_with_next(make(rows)).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, _, e in want), key=key)
    by_sha = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for i, t, nxt, e in want:
        r = by_sha[i, hashlib.sha256(e.encode()).hexdigest()]
        assert abs(r["near_edited"] - jaccard(t, e)) < 0.25 and (i == 9 or abs(r["near_next"] - jaccard(t, nxt)) < 0.25)
        assert r["fingerprint"] == minhash.as_hex(minhash.text_signature(t)) and (r["near_edited"] == 1.0 or t != e)
    assert minhash.fingerprints_with_next(make([])).count() == 0
    assert minhash.fingerprints_with_next(make([(5, "only one text here")])).first()["near_next"] == 1.0


def test_likeness_is_close_to_jaccard(prose):
    words = prose(1, 600).split()
    errors = []
    for n in range(0, 600, 25):
        a, b = " ".join(words[:400]), " ".join(words[n // 2: 400 + n // 2])
        errors.append(abs(minhash.likeness(minhash.text_signature(a), minhash.text_signature(b)) - jaccard(a, b)))
    assert np.mean(errors) < 0.05


def test_near_copies_share_a_class(make, prose):
    base = prose(5, 200)
    rows = [(1, base), (2, base + " extra"), (3, base), (4, prose(6, 200)), (5, None), (6, ""), (None, base)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(make(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, None: 1}


def test_edit_distance_against_tables():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64), rng.integers(1, 6, rng.integers(0, 60)).astype(np.uint64)
        row = np.zeros(len(text) + 1, int)
        for i, w in enumerate(item):
            new = [i + 1]
            for j, v in enumerate(text):
                new.append(min(row[j] + (w != v), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        assert decontaminate.distance(item, text)[0] == row.min()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_decontamination_recall(prose, share):
    rng = random.Random(int(share * 100))
    items = [(k, prose(k, 12 + k % 40)) for k in range(150)]
    index, found = decontaminate.Index(items), 0
    for k, t in items:
        words = t.split()
        for _ in range(int(share * len(words))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at: at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(999)}"]
        text = prose(1000 + k, 80) + "\n" + ", ".join(words).upper() + ". " + prose(2000 + k, 80)
        found += any(index.items[j][0] == k for _, j, *_ in index.search([decontaminate.word_codes(text)]))
    assert found >= 0.95 * len(items)


@pytest.mark.parametrize("n", [1, 4, 5, 8, 10, 12, 15, 16, 18, 25, 40])
def test_decontamination_misses_no_length(n):
    rng = random.Random(n)
    some = lambda k: [f"w{rng.randrange(20_000)}" for _ in range(k)]
    items = [(k, " ".join(some(n))) for k in range(150)]
    index, most = decontaminate.Index(items), decontaminate.allowed(n)
    for edits in {0, most}:
        for k, t in items:
            words = t.split()
            for j in range(edits):
                words[int((j + 0.5) * n / edits)] = f"new{j}"
            text = " ".join(some(40) + words + some(40))
            assert any(j == k and e <= edits for _, j, e, _ in index.search([decontaminate.word_codes(text)]))


def test_decontamination_in_spark(spark, make, prose):
    item, short = prose(1, 20), "alpha beta gamma delta epsilon"
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (5, "solo"), (6, item)], "item_id long, text string")
    rows = [(1, prose(2, 50) + " " + item), (2, prose(3, 60)), (3, None), (4, ""), (5, f"x {short} y"), (6, "alpha beta zeta gamma delta epsilon"), (7, "so solo"), (8, prose(4, 150_000) + " " + item + " end"),
            (None, item), (1, prose(2, 50) + " " + item)]
    docs = make(rows)
    got = sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in decontaminate.hits(docs, items).collect())
    assert got == sorted([("1", 1, 0), ("1", 1, 0), ("1", 6, 0), ("1", 6, 0), ("5", 2, 0), ("6", 2, 1), ("7", 5, 0), ("8", 1, 0), ("8", 6, 0), ("None", 1, 0), ("None", 6, 0)])
    left = decontaminate.clean(docs, items)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4] and left.columns == docs.columns
    assert decontaminate.hits(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.hits(make([]), items).count() == 0


def test_decontamination_finds_all_exact_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    flat = lambda t: f" {' '.join(decontaminate._WORD.findall(t.lower()))} "
    texts = [(r["doc_id"], flat(r["text"])) for r in docs.collect()]
    want = {(d, r["item_id"]) for r in items.collect() for d, t in texts if flat(r["text"]) in t}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.hits(docs, items).collect()}
    assert want and want == {k for k, edits in got.items() if edits == 0}


def test_url_rules_and_aliases(spark, duck):
    link = lambda to: f'<html><head><LINK href="{to}" rel="canonical"></head></html>'
    rows = [(1, "http://a.net/x", ""), (2, "http://Other.info/p?q#f", link("http://a.net/x")), (3, "https://www.other.info/p/", None), (4, "http://example.net/en/1", ""), (5, "http://m.example.net/fr/1", ""),
            (6, "http://third.info/", '<meta http-equiv="refresh" content="0; url=http://example.net/en/1">'), (7, "http://third.info", ""), (8, "http://third.info/x", link("/")), (9, "http://third.info/y", link("//a.net/x")),
            (10, None, ""), (11, "no scheme", ""), (12, "http://example.com/de/a", ""), (13, "http://xexample.com/de/a", ""), (14, "http://b.org/fr/", ""), (15, "http://net", ""), (16, "http://a.net", ""),
            (17, "a://b.net?x", ""), (18, "http://chain1.info/", link("http://chain2.info/")), (19, "http://chain2.info/", link("http://example.com/de/a")), (1, "http://a.net/x", ""), (None, "http://c.net/", None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert urls.judge(pages).count() == len(rows)
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("other.info", "/p", None, "block") and got[3] == ("www.other.info", "/p/", None, "block")
    assert got[4][2:] == ("example.net/en/", "allow") and got[5][2:] == ("net/", "block") and got[6][3] == got[7][3] == got[8][3] == "allow" and got[9][3] == "block"
    assert got[10] == got[11] == ("", "", None, "allow") and got[12][2:] == ("example.com/de/", "block") and got[13][2:] == (None, "allow") and got[14][2:] == ("org/fr/", "allow")
    assert got[15] == ("net", "", None, "allow") and got[17] == ("b.net", "", None, "allow") and got[18][3] == got[19][3] == "block"
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls._SQL})").fetchall()))
    assert want == sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in urls.judge(pages).collect())
    assert urls.judge(pages.limit(0)).count() == 0


def test_all_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(queries.QUERIES) <= set(names)


def test_queries_with_sql(spark, duck, sf):
    for name, sql in queries.ORACLES.items():
        ok, _, note = compare(spark, duck, sf, name, queries.QUERIES[name], sql)
        assert ok, (name, note)


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append(docs.count())
    assert before > seen[0] > seen[1] > seen[2] == seen[3] > 0.7 * before
    assert docs.where(F.regexp_like("text", F.lit(r"password=[0-9a-f]{8}"))).count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == seen[-1] and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_on_an_empty_and_an_odd_table(spark, make, sf):
    for rows in ([], [(1, None), (2, ""), (None, "plain words"), (3, "plain words"), (3, "plain words")]):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == {0: 0, 5: 4}[len(rows)]


def test_pipeline_ids_decode_to_the_text(spark, make, sf):
    out = corpus_pipeline.encode(spark, make([(1, "Plain words, naïve \u2581 ones\n\n"), (2, ""), (3, None)]), sf)
    assert {r["doc_id"]: (r["n_tokens"] > 0, r["round_trip"]) for r in out.collect()} == {1: (True, True), 2: (False, True), 3: (False, True)}
