"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, forests of partitions merged at their boundaries."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import table, width
from touchline.llm.registry import query
from touchline.session import cut

TURN = 16  # bytes of a turn's digest in a sequence
PART_BYTES = 32 << 20  # bytes of sequences in one partition
FAN_IN = 64  # partitions whose boundaries one partition of the next level merges
BLOCK_BITS = 8  # conversation ids that share their higher bits are joined first
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROW = "seq binary, sizes array<long>, n long, conv long, leaves long, saved long, kids long, ends string"
MADE = ROW + ", part int, slot long, up long, node_id binary, parent_id binary, depth long, parent long"


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of every conversation in order, each as its digest (hex) and the UTF-8 bytes of its text.

    turns has conv_id, turn, role and text; other columns are not read. Turns are ordered by `turn`, null first; equal ones by role, then digest.
    A null role or text is empty. Repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. Only digests are shuffled,
    so a conversation's path is small beside its texts; it is one array, as a text is one string.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(
        F.col("turn").alias("at"), role.alias("role"), digest.alias("turn"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["turn"].alias("turn"), t["bytes"].alias("bytes"))).alias("path"))


def grafted(of: DataFrame, family: int, most: int) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % family, then has its own turns after its first h; h = crc32(c) % most.

    `of` is the result of paths. A missing first conversation gives no turns, so a path can become empty.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = of.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head_id"))
    heads = of.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.slice("path", 1, most).alias("head"))
    begun = own.join(heads, "head_id", "left")
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("path", 1, 0))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return begun.select("conv_id", F.concat(first, rest).alias("path"))


def trie(of: DataFrame, part_bytes: int = PART_BYTES, fan_in: int = FAN_IN, parts: int | None = None) -> DataFrame:
    """All nodes of the prefix trie of the paths (conv_id, path), one conversation a row.

    A node is a different sequence of first turns; its members begin with it. Columns: node_id and parent_id (digests of the sequence; null above
    the root), conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes below, itself included),
    saved_tokens (over the nodes below, itself included, of (members - 1) times the bytes of the last text), ends_sha256 (of the ids of members that end there).

    Equal paths become one sequence first, so copies are not sorted. The sequences are sorted in `parts` ranges. Inside a range neighbours are joined
    by union-find, longest common prefix first; a join of two components is a branching node. Nodes that a neighbouring range can share (prefixes of its last or
    first sequence) stay open: what hangs on them is contracted to a row each, and these rows go through the same step in fewer ranges until one is left.
    No conversations: no nodes. Conversations without turns are members of the root only.
    """
    rows = cut(_sequences(of))
    held = rows.agg(F.sum(F.octet_length("seq") + 8 * F.size("sizes") + 96).alias("b")).first()["b"]
    if not held:
        return of.sparkSession.createDataFrame([], "node_id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
                                                   "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = _level(rows, parts or max(width(of.sparkSession), -(-held // part_bytes)), fan_in)
    return nodes.select("node_id", "parent_id", F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _sequences(of: DataFrame) -> DataFrame:
    """One row per different path. The ids of copies are joined in blocks of few first; the digest of all of them is then taken block by block."""
    flat = of.select("conv_id", F.unhex(F.array_join("path.turn", "")).alias("seq"), F.col("path.bytes").alias("sizes"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = flat.groupBy("seq", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), ids.alias("ids"))
    placed = blocks.repartition(width(of.sparkSession), "seq").sortWithinPartitions("seq", "block")
    return placed.mapInArrow(_fold, ROW)


def _fold(batches):
    """Blocks of the same sequence follow each other: their ids go through one running digest."""
    seq, state = None, None
    out: dict[str, list] = {c: [] for c in ("seq", "sizes", "n", "conv", "ends")}

    def close():
        if state is not None:
            for c, v in zip(out, (seq, *state[:3], state[3].hexdigest())):
                out[c].append(v)

    def flush():
        n = len(out["seq"])
        zero = pa.array(np.zeros(n, np.int64))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out["seq"], pa.binary()), pa.array(out["sizes"], pa.list_(pa.int64())), pa.array(out["n"], pa.int64()), pa.array(out["conv"], pa.int64()),
             zero, zero, zero, pa.array(out["ends"], pa.string())], names=["seq", "sizes", "n", "conv", "leaves", "saved", "kids", "ends"])
        for v in out.values():
            v.clear()
        return batch

    for b in batches:
        for s, sizes, n, conv, ids in zip(*(b.column(c).to_pylist() for c in ("seq", "sizes", "n", "conv", "ids"))):
            if s != seq:
                close()
                seq, state = s, [sizes, 0, conv, hashlib.sha256()]
            else:
                state[3].update(b",")
            state[1] += n
            state[3].update(ids.encode())
        if out["seq"]:
            yield flush()
    close()
    if out["seq"]:
        yield flush()


def _level(rows: DataFrame, parts: int, fan_in: int) -> DataFrame:
    """The nodes over rows of different sequences, sorted into ranges; what stays open at the boundaries is the input of the next level."""
    if parts > 1:
        placed = cut(rows.repartitionByRange(parts, "seq").withColumn("part", F.spark_partition_id()))
        edges = placed.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).coalesce(1).mapInPandas(_shared, "part int, lo long, hi long")
        placed = placed.join(edges, "part")
    else:
        placed = rows.select("*", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    made = placed.groupBy("part").applyInPandas(_forest, MADE)
    if parts == 1:
        return made
    made = cut(made)
    open_rows = made.where("slot IS NOT NULL")
    whole = open_rows.groupBy("seq").agg(F.first("sizes").alias("sizes"), *[F.sum(c).alias(c) for c in ("n",)], F.min("conv").alias("conv"),
                                         *[F.sum(c).alias(c) for c in ("leaves", "saved", "kids")], F.max("ends").alias("ends"))
    upper = cut(_level(whole, -(-parts // fan_in), fan_in))
    found = open_rows.select("part", F.col("slot").alias("up"), "node_id").join(upper.select("node_id", F.col("conv").alias("above")), "node_id").drop("node_id")
    closed = made.where("slot IS NULL")
    hung = closed.where("up IS NOT NULL").join(found, ["part", "up"])
    return (closed.where("up IS NULL").unionByName(hung.withColumn("parent", F.col("above")).select(*made.columns))
            .unionByName(upper))


def _shared(batches):
    """How many turns a range's first sequence shares with the last one before it, and its last with the first one after it; one row a range."""
    got = pd.concat(list(batches), ignore_index=True).sort_values("part")
    common = [_common(a, b) for a, b in zip(got["high"][:-1], got["low"][1:])]
    yield pd.DataFrame({"part": got["part"].astype("int32"), "lo": np.array([-1, *common], np.int64), "hi": np.array([*common, -1], np.int64)})


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(v, np.uint64, 2 * n).reshape(n, 2) for v in (a, b))
    off = np.flatnonzero((x != y).any(axis=1))
    return int(off[0]) if off.size else n


def _prefixes(seqs: list[bytes], lens: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in turns."""
    if len(seqs) < 2:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    least = np.minimum(lens[:-1], lens[1:])
    pair = np.repeat(np.arange(least.size), least)
    step = np.arange(pair.size) - np.repeat(np.cumsum(least) - least, least)
    differ = (flat[start[:-1][pair] + step] != flat[start[1:][pair] + step]).any(axis=1)
    out = least.copy()
    np.minimum.at(out, pair[differ], step[differ])
    return out


def _components(lens, lcp, n, conv, leaves, saved, kids, below):
    """Compressed nodes of a forest by union-find over the neighbour edges, deepest first.

    Node i < k is the end of row i, later ones are branching nodes in the order of their making. `below[r]` are running byte sums of row r. Returns per node
    its first row, depth, the depth of the node above, members, smallest member, children, leaves and saved bytes.
    """
    k = len(lens)
    first, depth, above = list(range(k)), list(lens), [-1] * k
    n, conv, leaves, saved, kids = (list(x) for x in (n, conv, leaves, saved, kids))
    boss, top = list(range(k)), list(range(k))  # union-find over rows; the top node of a component, kept at its root

    def find(x):
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    def close(node):
        if kids[node] == 0:
            leaves[node] = 1
        d = depth[node]
        if d > 0:
            sums = below[first[node]]
            saved[node] += (n[node] - 1) * (sums[d] - sums[d - 1])

    def hang(node, at, d):
        """The closed node becomes a child of the branching node `at` of depth d; the turns between them are a chain with the same members."""
        close(node)
        above[node] = d
        sums = below[first[node]]
        n[at] += n[node]
        conv[at] = min(conv[at], conv[node])
        kids[at] += 1
        leaves[at] += leaves[node]
        saved[at] += saved[node] + (n[node] - 1) * (sums[depth[node] - 1] - sums[d])

    for e in np.argsort(-lcp, kind="stable").tolist():
        d, a, b = int(lcp[e]), find(e), find(e + 1)
        at = top[a]
        if depth[at] > d:
            old, at = at, len(first)
            for column, value in ((first, first[old]), (depth, d), (above, -1), (n, 0), (conv, conv[old]), (leaves, 0), (saved, 0), (kids, 0)):
                column.append(value)
            hang(old, at, d)
        hang(top[b], at, d)
        boss[b] = a
        top[a] = at
    close(top[find(0)])
    return tuple(np.array(x, np.int64) for x in (first, depth, above, n, conv, kids, leaves, saved))


def _forest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Closed nodes of a range, and one row for each open node on which something closed hangs."""
    rows = rows.sort_values("seq", ignore_index=True)
    seqs, lo, hi = rows["seq"].tolist(), int(rows["lo"].iat[0]), int(rows["hi"].iat[0])
    lens = np.array([len(s) // TURN for s in seqs], np.int64)
    lcp = _prefixes(seqs, lens)
    below = [[0, *np.cumsum(s).tolist()] for s in rows["sizes"]]
    first, depth, above, n, conv, kids, leaves, saved = _components(lens.tolist(), lcp, *(rows[c].tolist() for c in ("n", "conv", "leaves", "saved", "kids")), below)

    # every node (row, depth) in the order of the rows: a row adds the depths beyond what it shares with the row before
    before = np.concatenate([[-1], lcp])
    start = np.cumsum(lens - before) - (lens - before)
    row = np.repeat(np.arange(lens.size), lens - before)
    at = np.arange(row.size) - start[row] + before[row] + 1
    ids, parent, path, states = [], np.full(row.size, -1, np.int64), [], []
    for i, (s, shared) in enumerate(zip(seqs, before.tolist())):
        del path[shared + 1:], states[shared + 1:]
        for x in range(shared + 1, int(lens[i]) + 1):
            state = states[-1].copy() if x else hashlib.blake2b(digest_size=16)
            state.update(s[TURN * (x - 1):TURN * x] if x else b"")
            parent[len(ids)] = path[-1] if x else -1
            path.append(len(ids))
            states.append(state)
            ids.append(state.digest())

    # a compressed node stands for the chain of depths above it up to the next node
    size = depth - above
    owner = np.repeat(np.arange(size.size), size)
    x = np.arange(owner.size) - (np.cumsum(size) - size)[owner] + above[owner] + 1
    spot = start[first[owner]] + x - before[first[owner]] - 1
    sums = np.concatenate([np.asarray(b, np.int64) for b in below])
    base = np.cumsum(lens + 1) - lens - 1
    last = x == depth[owner]
    chain = np.where(last, 0, sums[base[first[owner]] + np.maximum(depth[owner] - 1, 0)] - sums[base[first[owner]] + np.maximum(x - 1, 0)])
    node = {c: np.zeros(row.size, np.int64) for c in ("n", "conv", "kids", "leaves", "saved")}
    for c, v in (("n", n[owner]), ("conv", conv[owner]), ("kids", np.where(last, kids[owner], 1)), ("leaves", leaves[owner]), ("saved", saved[owner] + (n[owner] - 1) * chain)):
        node[c][spot] = v
    ends = np.full(row.size, None, object)
    ends[start + lens - before - 1] = rows["ends"].to_numpy()

    # prefixes that the ranges beside this one share
    falling = np.minimum.accumulate(lcp[::-1])[::-1] if lcp.size else lcp
    spine = {int(start[0] + d) for d in range(min(lo, int(lens[0])) + 1)}
    for d in range(min(hi, int(lens[-1])) + 1):
        r = int(np.searchsorted(falling, d))
        spine.add(int(start[r] + d - before[r] - 1))
    shut = np.ones(row.size, bool)
    shut[list(spine)] = False
    up = np.where((parent >= 0) & ~shut[parent], parent, -1)
    made = pd.DataFrame({"n": node["n"], "conv": node["conv"], "leaves": node["leaves"], "saved": node["saved"], "kids": node["kids"],
                         "ends": ends, "node_id": ids, "depth": at, "up": pd.array(up, "Int64"), "parent": pd.array(node["conv"][parent], "Int64"),
                         "parent_id": np.array([*ids, None], object)[parent]})
    made["ends"] = made["ends"].fillna(NO_ENDS)
    made.loc[up < 0, "up"] = pd.NA
    made.loc[(parent < 0) | (up >= 0), "parent"] = pd.NA
    made = made[shut]
    contracted = _contract(sorted(spine), parent, row, at, node, ends, ids, seqs, rows["sizes"], below)
    out = pd.concat([made, pd.DataFrame(contracted)], ignore_index=True) if contracted else made
    out["part"] = np.int32(key[0])
    for c in ("seq", "sizes", "slot"):
        if c not in out:
            out[c] = None
    for c in ("seq", "sizes", "parent_id", "ends"):
        out[c] = pd.Series([None if v is None or v is pd.NA or isinstance(v, float) else v for v in out[c]], dtype=object)
    for c in ("slot", "up", "parent", "depth", "n", "conv", "leaves", "saved", "kids"):
        out[c] = out[c].astype("Int64")
    return out[[f.split()[0] for f in MADE.split(", ")]]


def _contract(spine, parent, row, at, node, ends, ids, seqs, sizes, below):
    """What hangs on each open node beside its open children."""
    beside = {i: [] for i in spine}
    for i in spine:
        if parent[i] >= 0:
            beside[int(parent[i])].append(i)
    out = []
    for i in spine:
        r, d, open_kids = int(row[i]), int(at[i]), beside[i]
        members = int(node["n"][i] - sum(node["n"][j] for j in open_kids))
        kids = int(node["kids"][i]) - len(open_kids)
        if members == 0 and kids == 0:
            continue
        last = below[r][d] - below[r][d - 1] if d else 0
        out.append({"seq": seqs[r][:TURN * d], "sizes": list(sizes[r][:d]), "n": members, "conv": int(node["conv"][i]),
                    "leaves": int(node["leaves"][i] - sum(node["leaves"][j] for j in open_kids)) if node["kids"][i] else 0,
                    "saved": int(node["saved"][i] - (node["n"][i] - 1) * last - sum(node["saved"][j] for j in open_kids)),
                    "kids": kids, "ends": ends[i], "slot": i, "node_id": ids[i]})
    return out


SQL = """
WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32)) AS path
    FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, path, conv_id - conv_id % 5 AS head_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM own, bits),
built AS (SELECT h.conv_id, list_concat(coalesce(b.path, [])[:h.h], h.path[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.conv_id = h.head_id),
pre AS (SELECT conv_id, len(path) AS size, unnest(range(len(path) + 1)) AS depth, path FROM built),
node AS (SELECT depth, path[:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM pre GROUP BY ALL),
kid AS (SELECT depth - 1 AS depth, key[:depth - 1] AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(key[depth].t) END AS own_saved
    FROM node LEFT JOIN kid USING (depth, key)),
up AS (SELECT unnest(range(depth + 1)) AS lvl, key, n_children, own_saved FROM full_node),
below AS (SELECT lvl AS depth, key[:lvl] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN below b ON b.depth = f.depth AND b.key = f.key LEFT JOIN node p ON p.depth = f.depth - 1 AND p.key = f.key[:f.depth - 1]
"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, sf_dir):
    """All nodes of the trie over the rebuilt conversations; null and empty cases as in `paths`, `grafted` and `trie`."""
    nodes = trie(grafted(paths(table(spark, sf_dir, "conversations")), 5, 9))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
