"""Token counts by finite-state machines: how many tokens a byte-level BPE gives, without building the tokens.

Two machines are compiled from the tokenizer's file.

The *splitter* is a deterministic machine of eight states over eight kinds of character (the kind of a character includes what its pattern
looks ahead for: white space before a word, contractions); its transitions say where a piece begins. Text is cut into chunks;
all chunks advance together from every state at once, which gives a map from start state to end state for each; a parallel prefix
scan composes the maps, so each chunk learns its true start state, and a second run marks where pieces begin.

The *counter* is a deterministic transducer over bytes. Its state is what the tokens of longer texts can still depend on: the
longest suffix that begins a token, and for each place in it the last token of the encoding up to there and its count, relative to now.
Each transition is annotated with the change of the token count. States and transitions are compiled when first met and kept in a table that
numpy looks up for many places at once. Pieces are cut into chunks; all chunks of all pieces advance together. A piece's first chunk has one
start state; for a later one, the states that runs begun a little before it lead to are its likely start states, and running it from each
gives its state map, from start state to end state and tokens emitted. The same prefix scan composes the maps; a chunk whose true start state
its map lacks gets that state added, and the scan goes on from there. Equal pieces of a batch are counted once, and counts of pieces already met
are kept. All stores are bounded and start anew when full.

A token sequence is the tokenizer's own exactly if each neighbouring pair is, so the last token up to a place is the one suffix
token that can follow the last token up to its start.

Null text counts as empty: no bytes, no tokens. Special strings in a text are one token each and part it, as the library does
by default. Bytes that aren't UTF-8 are counted as U+FFFD, n_bytes are those stored. Null doc_ids and repeated rows are kept; other columns are ignored; empty in,
empty out.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Kinds of character. A2, A3: an apostrophe before one letter, or two, of a contraction; SPL, WL: a space, or other
# white space, before something else; WI: white space before white space or at the end.
L, N, P, A2, A3, SPL, WL, WI = range(8)
# States: END of a piece, in letters, digits, others, after a leading space, in white space, one or two letters before a contraction's end.
END, IN_L, IN_N, IN_P, IN_S, IN_W, LEFT1, LEFT2 = range(8)
_BEGIN = {L: IN_L, N: IN_N, P: IN_P, A2: LEFT1, A3: LEFT2, SPL: IN_S, WL: END, WI: IN_W}
_GO_ON = {
    IN_L: {L: IN_L},
    IN_N: {N: IN_N},
    IN_P: {P: IN_P, A2: IN_P, A3: IN_P},
    IN_S: {L: IN_L, N: IN_N, P: IN_P, A2: IN_P, A3: IN_P},
    IN_W: {WI: IN_W},
    LEFT1: dict.fromkeys(range(8), END),
    LEFT2: dict.fromkeys(range(8), LEFT1),
    END: {},
}
#: NEXT[kind, state], and STARTS[kind, state]: a piece begins with the character. Kinds from 8 on are those at the start of a text.
NEXT = np.array([[_GO_ON[s].get(k, _BEGIN[k]) for s in range(8)] for k in range(8)] + [[_BEGIN[k]] * 8 for k in range(8)], dtype=np.uint8)
STARTS = np.array([[k not in _GO_ON[s] for s in range(8)] for k in range(8)] + [[True] * 8] * 8)
_CHUNK = 256
#: Bytes that are counted before the stores' sizes are looked at again; bytes before a chunk, and places there, where runs for its start states begin.
_GROUP, _WARM, _LANES = 1 << 18, 32, 8


def _kinds_table() -> np.ndarray:
    """By code point: L, N, P, or WI for white space."""
    first = {"L": L, "N": N}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], P) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    # Code points of the Unicode property White_Space, fixed values.
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WI
    return table


_tables: dict[str, np.ndarray] = {}


def kinds(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The kind of each code point; starts: indices where a text begins."""
    if "kinds" not in _tables:
        _tables["kinds"] = _kinds_table()
    k = _tables["kinds"][points]
    n = len(points)
    last = np.zeros(n, dtype=bool)
    last[starts[1:] - 1] = last[n - 1 :] = True
    one = np.concatenate([points[1:], [0]])
    one[last] = 0
    two = np.concatenate([one[1:], [0]])
    two[last] = 0
    space = k == WI
    before_word = space & ~last & ~np.concatenate([space[1:], [False]])
    k[before_word] = np.where(points[before_word] == 0x20, SPL, WL)
    apostrophe = points == 0x27
    ch = {x: ord(x) for x in "stmdrevl"}
    k[apostrophe & ((one == ch["s"]) | (one == ch["t"]) | (one == ch["m"]) | (one == ch["d"]))] = A2
    k[apostrophe & ((((one == ch["r"]) | (one == ch["v"])) & (two == ch["e"])) | ((one == ch["l"]) & (two == ch["l"])))] = A3
    k[starts] += 8
    return k


def compose(maps: np.ndarray, first: int = END) -> np.ndarray:
    """The start state of each chunk from the chunks' state maps [chunks, states]: a parallel prefix scan, from the first chunk's start."""
    total, reach = maps.copy(), 1
    while reach < len(total):
        total[reach:] = np.take_along_axis(total[reach:], total[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[first], total[:-1, first]]).astype(maps.dtype)


def piece_starts(k: np.ndarray) -> np.ndarray:
    """Indices of the characters that begin a piece."""
    chunks = -(-len(k) // _CHUNK)
    grid = np.full(chunks * _CHUNK, WI, dtype=np.uint8)
    grid[: len(k)] = k
    grid = np.ascontiguousarray(grid.reshape(chunks, _CHUNK).T)
    flat_next = NEXT.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = flat_next[(row.astype(np.int32) * 8)[:, None] + maps]
    state, marks = compose(maps), np.empty((_CHUNK, chunks), dtype=bool)
    flat_starts = STARTS.ravel()
    for i, row in enumerate(grid):
        at = row.astype(np.int32) * 8 + state
        marks[i] = flat_starts[at]
        state = flat_next[at]
    return np.flatnonzero(marks.T.ravel()[: len(k)])


class Table:
    """Transitions by (state << 8 | byte), open-addressed: the next state and the change of the token count."""

    def __init__(self, log2: int = 16):
        self.log2, self.held = log2, 0
        self.keys, self.to, self.change = (
            np.full(1 << log2, -1, dtype=np.int64),
            np.zeros(1 << log2, dtype=np.int64),
            np.zeros(1 << log2, dtype=np.int64),
        )

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or the complement of the free place where it belongs."""
        with np.errstate(over="ignore"):
            place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log2)).astype(np.int64)
        there = self.keys[place]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.log2) - 1)
            there = self.keys[place[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return np.where(self.keys[place] == keys, place, ~place)

    def add(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        """Distinct keys that aren't held."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            kept = self.keys >= 0
            held = self.keys[kept], self.to[kept], self.change[kept]
            self.__init__((2 * (self.held + len(keys))).bit_length() + 1)
            self.add(*held)
        while len(keys):
            place = ~self.find(keys)
            _, first = np.unique(place, return_index=True)  # of keys that want the same place one takes it
            self.keys[place[first]], self.to[place[first]], self.change[place[first]] = keys[first], to[first], change[first]
            self.held += len(first)
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, to, change = keys[rest], to[rest], change[rest]


class Counter:
    """The transducer that counts the tokens of a piece."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], transitions: int = 400_000, pieces: int = 400_000):
        self.tokens, self.ranks, self.limit, self.piece_limit = tokens, ranks, transitions, pieces
        self.by_id = {i: t for t, i in tokens.items()}
        self.prefixes = {t[:k] for t in tokens for k in range(len(t))}
        self.splits: dict[bytes, tuple[bytes, bytes, int]] = {}
        for (a, b), r in ranks.items():
            self.splits.setdefault(a + b, (a, b, r))
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self.own: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,))]
        self.ids = {self.states[0]: 0}
        self.table = Table()
        self.seen: dict[bytes, int] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short text by its merges, least rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """What stands at the token's edge while it is merged, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.edges:
            parts = self.splits.get(token)
            self.edges[key] = (
                [(token, math.inf)] if parts is None else [
                    *self._edge(parts[1] if right else parts[0], right)[:-1],
                    (parts[1] if right else parts[0], parts[2]),
                    (token, math.inf),
                ]
            )
        return self.edges[key]

    def _follows(self, before: int, token: int) -> bool:
        """token can come after before (-1: at the start): no merge across their border comes before those inside them."""
        if before < 0:
            if token not in self.own:
                self.own[token] = self.merged(self.by_id[token]) == [self.by_id[token]]
            return self.own[token]
        left, right = self._edge(self.by_id[before], True), self._edge(self.by_id[token], False)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = self.ranks.get((a, b), math.inf)
            # Of equal merges the one more to the left comes first.
            if rank < a_ends and rank <= b_ends and rank < math.inf:
                return False
            if a_ends == b_ends == math.inf:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _id(self, state: tuple[bytes, tuple[int, ...], tuple[int, ...]]) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """A transition: the next state, and how the count changes."""
        window, lasts, behind = self.states[state]
        text = window + bytes([byte])
        for k in range(len(text)):
            token = self.tokens.get(text[k:])
            if token is not None and self._follows(lasts[k], token):
                change = 1 - behind[k]
                break
        lasts, behind = (*lasts, token), (*(x + change for x in behind), 0)
        gone = 0
        while text[gone:] not in self.prefixes:
            gone += 1
        return self._id((text[gone:], lasts[gone:], behind[gone:])), change

    def run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Advances from each state over size bytes from at, all together: the end states and the tokens counted."""
        order = np.argsort(-size, kind="stable")
        at, size, state, n = at[order], size[order], state[order], np.zeros(len(order), dtype=np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j))
            keys = state[:live] << 8 | data[at[:live] + j]
            place = self.table.find(keys)
            if (place < 0).any():
                new = np.unique(keys[place < 0])
                made = np.array([self._step(k >> 8, k & 255) for k in new.tolist()], dtype=np.int64)
                self.table.add(new, made[:, 0], made[:, 1])
                place = self.table.find(keys)
            state[:live] = self.table.to[place]
            n[:live] += self.table.change[place]
        back = np.argsort(order)
        return state[back], n[back]

    def _composed(self, data: np.ndarray, lo: int, hi: int, state: int) -> tuple[int, int]:
        """The end state and the tokens of data[lo:hi] from a state: chunks' maps from likely start states, composed by prefix scan."""
        begins = np.arange(lo, hi, _CHUNK)
        sizes = np.minimum(hi - begins, _CHUNK)
        # Likely start states: what runs begun at some places before a chunk lead to.
        lanes = [(i, max(lo, int(b) - d)) for i, b in enumerate(begins.tolist()) if i for d in range(_WARM, _WARM + _LANES)]
        chunk, at = (np.array(x, dtype=np.int64) for x in zip(*lanes, strict=True)) if lanes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends, _ = self.run(data, at, begins[chunk] - at, np.zeros(len(at), dtype=np.int64))
        pairs = np.unique(np.stack([np.append(chunk, 0), np.append(ends, state)], axis=1), axis=0)
        to, n = self.run(data, begins[pairs[:, 0]], sizes[pairs[:, 0]], pairs[:, 1].copy())
        maps = [dict[int, tuple[int, int]]() for _ in begins]
        for (c, s), e, k in zip(pairs.tolist(), to.tolist(), n.tolist(), strict=True):
            maps[c][s] = (e, k)
        at, total = 0, 0
        while at < len(maps):
            # Each map as places in the next one's list of start states; the last place stands for a start state that it lacks.
            lists = [list(m) for m in maps[at:]]
            most = max(map(len, lists))
            steps = np.full((len(lists), most + 1), most, dtype=np.int64)
            for i, own in enumerate(lists):
                after = {s: k for k, s in enumerate(lists[i + 1])} if i + 1 < len(lists) else {}
                steps[i, : len(own)] = [after.get(maps[at + i][s][0], most) for s in own]
            starts = compose(steps, lists[0].index(state)).tolist()
            for i, k in enumerate(starts):
                if k == most:  # its true start state is the end of the chunk before
                    end, count = self.run(data, begins[at : at + 1], sizes[at : at + 1], np.array([state]))
                    maps[at][state] = (int(end[0]), int(count[0]))
                    break
                state, count = maps[at][lists[i][k]]
                total, at = total + count, at + 1
        return state, total

    def _room(self) -> None:
        if self.table.held > self.limit:
            self._reset()

    def counts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of each piece of data."""
        out = np.zeros(len(begins), dtype=np.int64)
        sizes = ends - begins
        few = np.flatnonzero(sizes <= _CHUNK)
        for group in np.split(few, np.flatnonzero(np.diff(np.cumsum(sizes[few]) // _GROUP)) + 1):
            self._room()
            out[group] = self.run(data, begins[group], sizes[group], np.zeros(len(group), dtype=np.int64))[1]
        for i in np.flatnonzero(sizes > _CHUNK).tolist():
            state = self.states[0]
            for lo in range(int(begins[i]), int(ends[i]), _GROUP):
                self._room()
                end, n = self._composed(data, lo, min(lo + _GROUP, int(ends[i])), self._id(state))
                state = self.states[end]
                out[i] += n
        return out


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable Latin-1 as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE file of the tokenizers library, compiled."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        if d["model"]["type"] != "BPE" or d["pre_tokenizer"]["type"] != "ByteLevel" or d["pre_tokenizer"].get("add_prefix_space") or d.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        of = _byte_chars()
        raw = lambda s: bytes(of[c] for c in s)
        special = [t["content"] for t in d.get("added_tokens", [])]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        vocab = {raw(t): i for t, i in d["model"]["vocab"].items() if t not in special}
        self.special = [s.encode() for s in special]
        self.counter = Counter(vocab, {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)})

    def parts(self, text: bytes) -> tuple[list[bytes], int]:
        """The text's parts between special strings, and how many of these there are."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return [p for p in parts if p], len(parts) - 1

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        parts: list[bytes] = []
        owners: list[int] = []
        for i, t in enumerate(texts):
            own, special = self.parts(t)
            out[i] = special
            parts += own
            owners += [i] * len(own)
        if not parts:
            return out
        data = b"".join(parts)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        at_byte = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        starts = np.searchsorted(at_byte, edges[:-1])
        begins = at_byte[piece_starts(kinds(points, starts))]
        ends = np.append(begins[1:], len(data))
        raw = np.frombuffer(data, dtype=np.uint8)
        seen, pieces = self.counter.seen, [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        each = np.fromiter(map(seen.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(each < 0)
        if len(new):  # equal pieces, told by their bytes, are counted once
            found: dict[bytes, int] = {}
            of = np.fromiter((found.setdefault(pieces[i], i) for i in new.tolist()), dtype=np.int64, count=len(new))
            one = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            each[one] = self.counter.counts(raw, begins[one], ends[one])
            each[new] = each[of]
            seen = self.counter.seen
            if len(seen) + len(one) > self.counter.piece_limit:
                seen.clear()
            seen.update((pieces[i], n) for i, n in zip(one.tolist(), each[one].tolist(), strict=True) if len(pieces[i]) <= 64)
        first = np.searchsorted(begins, edges[:-1])
        np.add.at(out, owners, np.add.reduceat(each, first))
        return out


def valid(text: bytes) -> bytes:
    """The text, with U+FFFD for what isn't UTF-8 in it."""
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode("utf-8")
    return text


_compiled: dict[int, Tokenizer] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; tokenizer: path of a byte-level BPE file."""
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary; its size doesn't follow the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _compiled.setdefault(hash(spec.value), None) or Tokenizer(spec.value)
        _compiled[hash(spec.value)] = t
        for batch in batches:
            for part in common.text_slices(batch):
                texts = part.column(1).to_pylist()
                n = t.counts([valid(x) for x in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], type=pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
