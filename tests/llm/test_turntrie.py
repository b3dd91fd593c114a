"""The conversation trie against brute force: deep shared prefixes over many shards, copies, nulls, ties, turnless conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandframe.llm import turntrie

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, depth string"


def _key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role.encode(), _key(role, text), role, text))
    return {c: [(t[4], t[5]) for t in sorted(ts)] for c, ts in own.items()}


def _rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _brute(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children.get(p)
            saved[p[:d]] += own
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -(2**63), len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()
    )


def _got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-(2**63) if r[n] is None else r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["", "a", "b", "é", "😀 x"]
    out = []
    for c in [*range(-150, 400), 10**15, *range(8_000_000_001, 8_000_000_040)]:
        for turn in range(rng.randint(0, 7)):
            out.append((c, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", None]), rng.choice([*words, None])))
    for c in range(1000, 1040):  # long prefixes in common, which differ after more turns than a sort key has
        out += [(c, t, "user", f"t{t}") for t in range(45)] + [(c, 50 + t, "user", f"x{c % 7}{t}") for t in range(c % 5)]
    out += [(c, 0, "user", "same") for c in range(20_000, 29_500)]  # copies
    out += [out[5], out[5], (None, 1, "user", "nobody's")]
    return out


def _table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p", "d") for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("partitions", ["1", "60"])
def test_nodes(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _got(turntrie.nodes(turntrie.sequences(_table(spark, rows)))) == _brute(_sequences(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rebuilt_query(spark, rows, tmp_path):
    some = [r for r in rows if r[0] is None or r[0] < 1040 or r[0] > 10**9]
    _table(spark, some).write.parquet(str(tmp_path / "conversations.parquet"))
    want = _rebuilt(_sequences(some))
    assert any(not t for t in want.values())
    assert _got(turntrie.op12_conversation_trie(spark, str(tmp_path))) == _brute(want)


def test_empty(spark, rows):
    assert turntrie.nodes(turntrie.sequences(_table(spark, rows).limit(0))).count() == 0
    only = _table(spark, [(None, 1, "user", "x")])
    assert turntrie.nodes(turntrie.sequences(only)).count() == 0


def test_double_array_holds_its_trie_and_nothing_else():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 9, 300)
    ids = rng.integers(0, 40, int(sizes.sum())) ** 2 % 97
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parent, label = turntrie._levels(ids, starts, sizes)
    trie = turntrie.DoubleArray(parent, label)
    pairs = {(int(p), int(c)) for p, c in zip(parent[1:], label[1:])}
    assert len(pairs) == len(parent) - 1 and len(set(trie.slot.tolist())) == len(parent)
    at = {int(s): n for n, s in enumerate(trie.slot)}
    for n in range(len(parent)):
        for c in range(int(label.max()) + 2):
            to = int(trie.step(trie.slot[[n]], np.array([c]))[0])
            assert ((n, c) in pairs) == (to >= 0)
            assert to < 0 or (parent[at[to]], label[at[to]]) == (n, c)
    assert (trie.check != -1).sum() == len(parent)
