"""The prefix trie against a dictionary of prefixes, over many partitions and levels."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from touchline.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, part int, seq string"


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]} by listing all prefixes."""
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[:d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)

    def below(p):
        out, stack = [], [p]
        while stack:
            q = stack.pop()
            out.append(q)
            stack += kids[q]
        return out

    rows = []
    for p, m in list(members.items()):
        nodes = below(p)
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in nodes),
                     sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in nodes if q),
                     hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(rows, key=str)


def turns(convs):
    return [(c, i, r, t, "x", 1, 2, "y") for c, path in convs.items() for i, (r, t) in enumerate(path)]


def rows_of(nodes):
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in nodes.select(*cols).collect()), key=str)


def family(seed, n, copies=0):
    r, out = random.Random(seed), {}
    for c in range(n):
        base = list(out[r.choice(list(out))][: r.randint(0, 6)]) if out and r.random() < 0.7 else []
        out[c] = base + [(r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc", "", "long " * 5])) for _ in range(r.randint(0, 4))]
    for c in range(n, n + copies):
        out[c] = list(out[3])
    return out


@pytest.mark.parametrize("parts, fan_in", [(1, 64), (3, 2), (9, 3), (40, 2)])
def test_trie_equals_all_prefixes(spark, parts, fan_in):
    """Whatever the ranges and levels, a third of all rows being copies of one conversation."""
    convs = family(parts, 120, 60)
    of = prefixes.paths(spark.createDataFrame(turns(convs), SCHEMA))
    got = rows_of(prefixes.trie(of, parts=parts, fan_in=fan_in))
    assert got == brute({c: p for c, p in convs.items() if p})


def test_one_hot_opening_and_a_long_conversation(spark):
    """All share their first turns and one is long: every boundary cuts the shared prefix."""
    head = [("system", "s" * 30)] * 4
    convs = {c: [*head, ("user", str(c % 50)), ("assistant", str(c))] for c in range(200)}
    convs[500] = [*head, *[("user", str(i % 3)) for i in range(3000)]]
    convs[501] = [*convs[500], ("user", "end")]
    convs[502] = list(head)
    of = prefixes.paths(spark.createDataFrame(turns(convs), SCHEMA))
    got = rows_of(prefixes.trie(of, parts=16, fan_in=4))
    fast = {r[:2]: r for r in got}
    assert len(got) == 4 + 1 + 50 + 200 + 3000 - 1 + 1  # the long one begins with a turn that others have
    assert fast[0, 0][3:6] == (203, 1, 201) and fast[0, 4][4] == 50
    small = {c: p for c, p in convs.items() if c < 500 or c == 502}
    assert rows_of(prefixes.trie(prefixes.paths(spark.createDataFrame(turns(small), SCHEMA)), parts=16, fan_in=4)) == brute(small)


def test_ids_link_nodes(spark):
    convs = family(5, 40)
    nodes = prefixes.trie(prefixes.paths(spark.createDataFrame(turns(convs), SCHEMA)), parts=6, fan_in=2).collect()
    by = {bytes(r["node_id"]): r for r in nodes}
    assert len(by) == len(nodes)
    for r in nodes:
        if r["depth"]:
            up = by[bytes(r["parent_id"])]
            assert (up["depth"], up["conv_id"]) == (r["depth"] - 1, r["parent_conv_id"])


def test_grafts(spark):
    convs = {c: [("user", f"{c}-{i}") for i in range(n)] for c, n in {0: 3, 1: 9, 3: 1, 5: 12, 6: 2, 11: 4, 14: 1, -7: 2}.items()}
    got = {r["conv_id"]: [t["turn"] for t in r["path"]] for r in prefixes.grafted(prefixes.paths(spark.createDataFrame(turns(convs), SCHEMA)), 5, 9).collect()}
    plain = {r["conv_id"]: [t["turn"] for t in r["path"]] for r in prefixes.paths(spark.createDataFrame(turns(convs), SCHEMA)).collect()}
    for c in convs:
        h, head = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        assert got[c] == plain.get(head, [])[:h] + plain[c][h:], c


def test_edges(spark):
    """Null role and text are empty, null turns come first, rows without conv_id are left out, repeated rows count, empty tables give nothing."""
    rows = [(1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "lost"), (2, 5, "", "x")]
    of = prefixes.paths(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA))
    assert rows_of(prefixes.trie(of, parts=2, fan_in=2)) == brute({1: [("", "x"), ("user", ""), ("user", "")], 2: [("", "x")]})
    assert prefixes.trie(prefixes.paths(spark.createDataFrame([], SCHEMA))).collect() == []
    empty = spark.createDataFrame([(4, []), (9, [])], "conv_id long, path array<struct<turn:string,bytes:long>>")
    assert rows_of(prefixes.trie(empty)) == brute({4: [], 9: []})
