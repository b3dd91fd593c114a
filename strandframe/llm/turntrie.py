"""Conversation prefix trie: double-array tries of prefix shards, and one merge of the nodes that shards share.

A conversation is the sequence of its turns; a turn is known by the SHA-256 of its role and text, so texts are shuffled nowhere. Sequences are range-partitioned by the
first 8 bytes of their turns' hashes and by conv_id, so a shard holds neighbouring prefixes and a prefix that a third of all conversations begin with
goes over as many shards as its rows need. In a shard, distinct turns get dense ids, numbered in the order in which the trie's levels meet them, and the trie is packed into
a BASE and a CHECK array (the child of slot s by turn c is at BASE[s] + c if CHECK there is s). All conversations walk the arrays level by level, which gives each
node's members and least conv_id; sums over subtrees go up along CHECK.

Only nodes on the prefixes of a shard's first and last sequences can have members in other shards. These upper nodes' parts (a row each, with the keys of their ancestors) are
merged globally; all others are final where they are. Digests of members are streamed in conv_id order: in the shard for its own nodes, over pieces of ids
for shared ones, so no list of members is ever held whole. A conversation's turns (40 bytes each, not their texts) are held by one task.

Turns are ordered by turn number, null first; turns of one number by role, then by their hash; null role or text counts as empty. Rows without
conv_id belong to no conversation. Equal rows are turns of their own; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Turns that one trie is built of at most (or one conversation), ids in a piece of a digest, bytes and turns of the sort key.
SHARD_TURNS, PIECE_IDS, KEY_BYTES, KEY_TURNS = 400_000, 4096, 8, 32
#: Copies of the shared nodes' table that children are dealt over.
SALTS = 16

_OUT = pa.schema(
    [
        ("kind", pa.int8()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.string()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("chars", pa.int64()),
        ("ups", pa.list_(pa.binary())),
    ]
)
_OUT_SQL = "kind byte, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, node binary, parent binary, chars long, ups array<binary>"
FINAL, SHARED, PIECE = 0, 1, 2


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (key, chars), in order, of all conversations of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).filter("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Each conversation's first ``heads`` turns (``most`` at most) replaced by as many of the conversation ``base``, all if it has fewer, none if there is none."""
    named = own.select("conv_id", "turns", base.alias("_strand_base"), heads.cast("int").alias("_strand_h"))
    first = own.join(named.select(F.col("_strand_base").alias("conv_id")).distinct(), "conv_id", "left_semi").select(F.col("conv_id").alias("_strand_base"), F.slice("turns", 1, most).alias("_strand_head"))
    head = F.slice(F.coalesce("_strand_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_strand_h"))
    rest = F.slice("turns", F.col("_strand_h") + 1, F.greatest(F.size("turns") - F.col("_strand_h"), F.lit(0)))
    return named.join(first, "_strand_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class DoubleArray:
    """A trie in two arrays. Slot 0 is the root; unused slots have CHECK -1, the root -2. BASE may be negative."""

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        """parent and label of nodes 1, 2, ..., after their parents, the children of a node side by side; node 0 is the root."""
        n = len(parent)
        self.slot = np.zeros(n, dtype=np.int64)
        self.base = np.zeros(n + 1, dtype=np.int64)
        self.check = np.full(n + 1, -1, dtype=np.int64)
        self.check[0], free = -2, 1
        begins = np.flatnonzero(np.diff(parent[1:], prepend=-1)) + 1
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True):
            low = label[lo:hi].min()
            offsets = label[lo:hi] - low
            at = self._place(offsets, free)
            slots, above = at + offsets, self.slot[parent[lo]]
            self.base[above] = at - low
            self.check[slots], self.slot[lo:hi] = above, slots
            while free < len(self.check) and self.check[free] != -1:
                free += 1

    def _place(self, offsets: np.ndarray, free: int, tries: int = 64) -> int:
        """Where all of a node's children find free slots: near the first free one, or at the end."""
        need, at = int(offsets.max()) + 1, free
        for _ in range(tries):
            self._grow(at + need)
            taken = self.check[at + offsets] != -1
            if not taken.any():
                return at
            at += 1
        used = np.flatnonzero(self.check != -1)
        at = max(free, int(used[-1]) + 1)
        self._grow(at + need)
        return at

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, dtype=np.int64)]), np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of slots by labels; -1 where there is none."""
        at = self.base[slots] + labels
        inside = (at >= 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == slots), at, -1)


def _levels(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and turn of each node, level by level, of the sequences ids[start : start + size]; children of a node are neighbours. Turns are renumbered in that order, also in ids."""
    parents, labels, made = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 1
    state, depth, width = np.zeros(len(sizes), dtype=np.int64), 0, int(ids.max()) + 1 if len(ids) else 1
    live = np.flatnonzero(sizes > 0)
    while len(live):
        pairs, number = np.unique(state[live] * width + ids[starts[live] + depth], return_inverse=True)
        parents.append(pairs // width)
        labels.append(pairs % width)
        state[live] = made + number
        made, depth = made + len(pairs), depth + 1
        live = live[sizes[live] > depth]
    parent, label = np.concatenate(parents), np.concatenate(labels)
    seen, first = np.unique(label[1:], return_index=True)
    dense = np.zeros(width, dtype=np.int64)
    dense[seen[np.argsort(first)]] = np.arange(len(seen))
    ids[:] = dense[ids]
    return parent, dense[label]


def shard_nodes(convs: np.ndarray, order: list[bytes], sizes: np.ndarray, keys: list[bytes], chars: np.ndarray) -> pa.RecordBatch:
    """Rows of _OUT for one shard: conversations in order, their sort keys and sizes, and keys and chars of all their turns, one after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(k, len(number)) for k in keys), dtype=np.int64, count=len(keys))
    parent, label = _levels(ids, starts, sizes)
    trie = DoubleArray(parent, label)
    width = len(trie.check)
    # A node down to this depth shares its sort key's bytes with the shard's first or last sequence, so it may have members elsewhere.
    edge = np.array([max(_common(t, order[0]), _common(t, order[-1])) for t in order], dtype=np.int64)
    edge = np.where(edge >= KEY_TURNS, np.iinfo(np.int64).max, edge)

    members, least = np.zeros(width, dtype=np.int64), np.full(width, np.iinfo(np.int64).max, dtype=np.int64)
    deep, length, shared, sample = (np.zeros(width, dtype=k) for k in (np.int64, np.int64, bool, np.int64))
    state, live, depth = np.zeros(len(convs), dtype=np.int64), np.arange(len(convs)), 0
    while True:
        at = state[live]
        np.add.at(members, at, 1)
        np.minimum.at(least, at, convs[live])
        deep[at], shared[at], sample[at] = depth, edge[live] >= depth, live
        if depth:
            length[at] = chars[starts[live] + depth - 1]
        live = live[sizes[live] > depth]
        if not len(live):
            break
        state[live] = trie.step(state[live], ids[starts[live] + depth])
        if (state[live] < 0).any():
            raise AssertionError("a sequence isn't in its own trie")
        depth += 1

    slots = np.flatnonzero(trie.check != -1)
    slots = slots[np.argsort(deep[slots], kind="stable")]
    above = trie.check[slots]
    children = np.bincount(above[(above >= 0) & ~shared[slots]], minlength=width)  # children that other shards have too are counted when merged
    every = np.bincount(above[above >= 0], minlength=width)
    leaves = np.where(shared, 0, (every == 0).astype(np.int64))
    saved = np.where(shared, 0, (members - 1) * length)
    levels = np.searchsorted(deep[slots], np.arange(depth + 2))
    for d in range(depth, 0, -1):
        level = slots[levels[d] : levels[d + 1]]
        level = level[~shared[level]]
        np.add.at(leaves, trie.check[level], leaves[level])
        np.add.at(saved, trie.check[level], saved[level])

    ends: dict[int, str] = {}
    pieces: list[tuple[int, int, str]] = []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(state)) + 1, [len(convs)]]).tolist()
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        to = int(state[lo])
        if not shared[to]:
            ends[to] = hashlib.sha256(",".join(map(str, convs[lo:hi].tolist())).encode()).hexdigest()
        else:
            pieces += [(to, int(convs[i]), ",".join(map(str, convs[i : min(hi, i + PIECE_IDS)].tolist()))) for i in range(lo, hi, PIECE_IDS)]

    chain: dict[int, bytes] = {0: b""}
    paths: dict[int, list[bytes]] = {0: [b""]}
    for s in slots[shared[slots]].tolist():
        if s:
            up = int(trie.check[s])
            chain[s] = hashlib.sha256(chain[up] + keys[starts[sample[s]] + deep[s] - 1]).digest()
            paths[s] = [*paths[up], chain[s]]
    none = hashlib.sha256(b"").hexdigest()
    rows = {name: [] for name in _OUT.names}

    def put(*values) -> None:
        for column, value in zip(rows.values(), values, strict=True):
            column.append(value)

    for s in slots.tolist():
        up = int(trie.check[s])
        split = up >= 0 and shared[up]
        if shared[s]:
            put(SHARED, least[s], deep[s], None, members[s], children[s], leaves[s], saved[s], None, chain[s], chain[up] if up >= 0 else None, length[s], paths[s])
        else:
            put(FINAL, least[s], deep[s], None if split else least[up], members[s], children[s], leaves[s], saved[s], ends.get(s, none), None, chain[up] if split else None, None, None)
    for to, first, piece in pieces:
        put(PIECE, first, deep[to], None, None, None, None, None, piece, chain[to], None, None, None)
    return pa.RecordBatch.from_pydict(rows, schema=_OUT)


def _common(a: bytes, b: bytes) -> int:
    """Turns whose bytes in two sort keys are the same, from the first on."""
    if a == b:
        return KEY_TURNS if len(a) == KEY_TURNS * KEY_BYTES else len(a) // KEY_BYTES
    n = 0
    while n < min(len(a), len(b)) and a[n : n + KEY_BYTES] == b[n : n + KEY_BYTES]:
        n += KEY_BYTES
    return n // KEY_BYTES


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, order, sizes, keys, chars, held = [], [], [], [], [], 0

    def made() -> pa.RecordBatch:
        return shard_nodes(np.concatenate(convs), order, np.concatenate(sizes), keys, np.concatenate(chars))

    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            own = part.column(2)
            size = np.diff(own.offsets.to_numpy()).astype(np.int64)
            flat = own.flatten()
            if held and held + len(flat) > SHARD_TURNS:
                yield made()
                convs, order, sizes, keys, chars, held = [], [], [], [], [], 0
            convs.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            order += part.column(1).to_pylist()
            sizes.append(size)
            keys += flat.to_pylist()
            chars.append(part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(flat)
    if convs:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 of pieces sorted by node and first id; one running digest."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest is not None and key == node:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], type=pa.binary()), pa.array([x[1] for x in done], type=pa.string())], names=["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], type=pa.binary()), pa.array([digest.hexdigest()], type=pa.string())], names=["node", "ends_sha256"])


def nodes(found: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    short = F.transform(F.slice("turns", 1, KEY_TURNS), lambda t: F.substring(F.hex(t["key"]), 1, 2 * KEY_BYTES))
    rows = found.select("conv_id", F.unhex(F.array_join(short, "")).alias("place"), F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    dealt = rows.repartitionByRange("place", "conv_id").sortWithinPartitions("place", "keys", "conv_id")
    made = common.cut(dealt.mapInArrow(_shards, _OUT_SQL), "turntrie-shards")
    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    parts = made.filter(F.col("kind") == SHARED).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.first("ups").alias("ups"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    parts = common.cut(parts, "turntrie-shared")
    under = parts.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("shared_children"))
    with_children = parts.join(under, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("shared_children", F.lit(0)))
    own_leaf = (F.col("n_children") == 0).cast("long")
    given = with_children.select("node", "n_children", "conv_id", "depth", "parent", "n_convs", "ups", (F.col("n_leaves") + own_leaf).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = given.select(F.explode("ups").alias("node"), "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    pieces = made.filter(F.col("kind") == PIECE).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    names = parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = (
        given.drop("leaves", "saved").join(sums, "node").join(names, "parent", "left").join(pieces.mapInArrow(_digests, "node binary, ends_sha256 string"), "node", "left")
        .select(*figures, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )

    final = made.filter(F.col("kind") == FINAL).withColumnRenamed("ends", "ends_sha256")
    whole = final.filter("parent IS NULL").select(*figures, "ends_sha256")
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int").alias("salt")
    copies = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hung = final.filter("parent IS NOT NULL").drop("parent_conv_id").select("*", salt).join(copies, ["parent", "salt"]).select(*figures, "ends_sha256")
    return shared.unionByName(whole).unionByName(hung)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 100, h = crc32(c) % 6, in place of its own."""
    own = sequences(common.docs_of(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return nodes(rebuilt(own, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5))


_TURN = "sha256(length(role) || ':' || role || text)"
ORACLE = {
    "op12_conversation_trie": f"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, {_TURN} AS k, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_TURN}) AS pos FROM raw),
ids AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t) AS d),
r AS (SELECT ids.conv_id, 0 AS part, t.pos, t.k, t.chars FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 100 AND t.pos <= ids.h
  UNION ALL SELECT ids.conv_id, 1, t.pos, t.k, t.chars FROM ids JOIN t ON t.conv_id = ids.conv_id AND t.pos > ids.h),
s AS (SELECT ids.conv_id, coalesce(l.ks, []) AS ks, coalesce(l.cs, []) AS cs
  FROM ids LEFT JOIN (SELECT conv_id, list(k ORDER BY part, pos) AS ks, list(chars ORDER BY part, pos) AS cs FROM r GROUP BY conv_id) AS l USING (conv_id)),
p AS (SELECT conv_id, d, array_to_string(ks[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars, d = len(ks) AS at_end
  FROM (SELECT *, unnest(generate_series(0, len(ks))) AS d FROM s) AS q),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, max(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end), '') AS ends
  FROM p GROUP BY node, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
a AS (SELECT p.node, p.d, CAST(sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.chars) AS BIGINT) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.node, p.d)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a ON a.node = f.node AND a.d = f.d LEFT JOIN n AS u ON u.node = f.up AND u.d = f.d - 1
"""
}
