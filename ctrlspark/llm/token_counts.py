"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled into a deterministic transducer over
bytes.  Its transitions carry the *change* in the number of tokens that the
bytes read so far encode to.  A state remembers the longest suffix of the
pre-token that may still grow into a longer token and, for each place in that
suffix, the last token and the number of tokens of the encoding up to there;
this is all that the next step depends on, because every prefix of a pre-token
has one valid last token (a token is valid after another if the two encode to
themselves).  States are made when first reached and kept in one table.

Texts are cut into equal chunks that advance side by side.  A chunk's state map
leads from an entry state to an exit state and a count.  A chunk with a pre-token
boundary has one exit state; only the head of bytes before its first boundary
depends on the entry.  A chunk inside one pre-token has a map of the few entry states
that its predecessor's map leads to (a guessed one included); as what came a thousand bytes before seldom
matters, these are one or two, and at most the phases of a token in long repetitions, whose chunks of equal
bytes share one map.  The maps are then composed by a parallel prefix scan: maps of 1, 2, 4, ... chunks are made from one another, and
every chunk of a run finds its entry state in as many steps as its distance has bits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import pretokens, textvec

START, DEAD, BIAS = 0, 1, 128
#: rows of the transition table; a full table is emptied and filled again
MAX_STATES = 100_000
LANE = 1024


def byte_alphabet() -> dict[str, int]:
    """The published byte alphabet: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Deterministic transducer from bytes of a pre-token to changes in its token count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        added = {t["id"] for t in spec["added_tokens"]}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.token = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if i not in added}
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(spec["model"]["merges"])}
        self.made = {a + b: (r, a, b) for (a, b), r in self.rank.items()}
        self.growing: dict[bytes, list[bytes]] = {}
        for t in self.token:
            for i in range(1, len(t)):
                self.growing.setdefault(t[:i], []).append(t)
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.alike: dict[tuple, bytes | bool | None] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((4096, 256), -1, np.int32)
        self._state((b"", (None,), (0,)))  # START
        self._state(None)  # DEAD: counts nothing, leaves only at a boundary
        self.table[DEAD] = DEAD << 8 | BIAS

    def _state(self, key: tuple | None) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            if got == len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        return got

    def _seam_holds(self, a: bytes, b: bytes) -> bool:
        """Undo the merges that face the seam, latest first; no merge across it may come before the one undone."""
        before = 1 << 30
        while True:
            if self.rank.get((a, b), 1 << 30) < before:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                before, a = made_a[0], made_a[2]
            else:  # of equal merges the left one comes first
                before, b = made_b[0] + 1, made_b[1]

    def _encodes_to_itself(self, a: bytes, b: bytes) -> bool:
        known = self.valid.get((a, b))
        if known is None:
            known = self._seam_holds(a, b)
            if len(self.valid) > 200_000:
                self.valid.clear()
            self.valid[(a, b)] = known
        return known

    def _standin(self, suffix: bytes, last: bytes | None) -> bytes | bool | None:
        """One of the tokens after which the same tokens that grow from ``suffix`` are valid; False if none is."""
        if last is False:
            return False
        got = self.alike.get((suffix, last), ())
        if got == ():
            if len(self.alike) > 400_000:
                self.alike.clear()
            tokens = self.growing[suffix]
            if len(tokens) > 100:
                return last
            mask = sum(1 << i for i, t in enumerate(tokens) if last is None or self._seam_holds(last, t))
            got = self.alike[(suffix, last)] = self.alike.setdefault((suffix, mask), last) if mask else False
        return got

    def compile(self, state: int, byte: int) -> None:
        """Fill one transition."""
        tail, last, count = self.states[state]
        seen = tail + bytes([byte])
        for size in range(len(seen), 0, -1):
            piece, at = seen[-size:], len(seen) - size
            if piece in self.token and last[at] is not False and (last[at] is None or self._encodes_to_itself(last[at], piece)):
                break
        change = count[at] + 1
        lasts, counts = (*last, piece), (*count, change)
        may = [self._standin(seen[i:], lasts[i]) if seen[i:] in self.growing else False for i in range(len(seen))]
        keep = next((i for i, x in enumerate(may) if x is not False), len(seen))
        key = (seen[keep:], (*may[keep:], piece), tuple(0 if x is False else c - change for x, c in zip(may[keep:], counts[keep:])) + (0,))
        self.table[state, byte] = self._state(key) << 8 | (change + BIAS)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Transitions taken: next state in the upper bits, change plus BIAS in the lowest 8."""
        while True:
            got = self.table.ravel()[state * 256 + byte]
            missing = got < 0
            if not missing.any():
                return got
            for pair in np.unique(state[missing] * 256 + byte[missing]):
                self.compile(int(pair) >> 8, int(pair) & 255)

    def heads(self, grid: np.ndarray, lane: np.ndarray, entry: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of the first ``length`` bytes of chunks from entry states, all pairs side by side."""
        order = np.argsort(-length, kind="stable")
        lane, now, falling = lane[order], entry[order].astype(np.int64), -length[order]
        total = np.zeros(len(order), np.int64)
        for i in range(int(-falling[0])):
            on = np.searchsorted(falling, -i)  # those longer than i come first
            got = self.step(now[:on], grid[i, lane[:on]])
            now[:on] = got >> 8
            total[:on] += (got & 255) - BIAS
        out, counts = np.empty_like(now), np.empty_like(total)
        out[order], counts[order] = now, total
        return out, counts

    def head_counts(self, grid: np.ndarray, head: np.ndarray, through: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks whose head isn't empty, token count of each head), from the chunks' exit states where those are known."""
        lanes = len(head)
        exact = np.concatenate(([True], ~through[:-1]))  # the entry state follows from the chunk before alone
        before = np.concatenate(([START], state[:-1]))
        todo = np.flatnonzero(head > 0)
        leads = through.copy()  # to another head
        leads[:-1] &= head[1:] > 0
        leads[-1] = False
        node = np.arange(lanes)  # the first chunk of the same bytes, whose map it shares
        whole = np.flatnonzero(through & (head == LANE))
        if len(whole):
            _, at, same = np.unique(np.ascontiguousarray(grid[:, whole].T).view(f"V{LANE}").ravel(), return_index=True, return_inverse=True)
            node[whole] = whole[at][same]
        on = np.flatnonzero(leads)
        links = np.unique(node[on] << 32 | node[on + 1])
        source, target = links >> 32, links & 0xFFFFFFFF

        entry = np.where(exact[todo], before[todo], START)
        fresh = np.unique(node[todo] << 32 | entry)
        pairs, exits, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(fresh):  # maps: entry states that a map of the chunk before leads to are added until there is no other
            chunk = fresh >> 32
            out, count = self.heads(grid, chunk, fresh & 0xFFFFFFFF, head[chunk])
            pairs, exits, counts = np.concatenate((pairs, fresh)), np.concatenate((exits, out)), np.concatenate((counts, count))
            low, many = np.searchsorted(source, chunk), np.searchsorted(source, chunk, "right") - np.searchsorted(source, chunk)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            fresh = np.setdiff1d(target[np.repeat(low, many) + nth] << 32 | np.repeat(out, many), pairs)
        order = np.argsort(pairs)
        pairs, exits, counts = pairs[order], exits[order], counts[order]

        # a row for each chunk and entry state of its map
        low = np.searchsorted(pairs, node << 32)
        size = np.where(head > 0, np.searchsorted(pairs, node + 1 << 32) - low, 0)
        base = np.cumsum(size) - size
        lane = np.repeat(np.arange(lanes), size)
        pair = np.arange(len(lane)) - base[lane] + low[lane]
        row = lambda to, state: base[to] + np.searchsorted(pairs, node[to] << 32 | state) - low[to]
        hop = np.arange(len(lane))  # the map of one chunk: the next chunk's row
        goes = leads[lane]
        hop[goes] = row(lane[goes] + 1, exits[pair[goes]])
        begin = np.maximum.accumulate(np.where(exact, np.arange(lanes), 0))[todo]
        at = row(begin, before[begin])
        far = todo - begin
        while far.any():  # scan: hop is the composed map of 1, 2, 4, ... chunks
            at = np.where(far & 1, hop[at], at)
            hop, far = hop[hop], far >> 1
        return todo, counts[pair[at]]

    def changes(self, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte; that of a chunk's head stands at the head's last byte."""
        n = len(buf)
        if len(self.states) > MAX_STATES:
            self.reset()
        lanes = -(-n // LANE)
        grid = np.zeros(lanes * LANE, np.uint8)
        grid[:n] = buf
        go = np.zeros(lanes * LANE, bool)
        go[:n] = begins
        grid, go = np.ascontiguousarray(grid.reshape(lanes, LANE).T), np.ascontiguousarray(go.reshape(lanes, LANE).T)
        out = np.zeros((LANE, lanes), np.int16)
        state = np.full(lanes, DEAD, np.int64)
        for i in range(LANE):  # bodies: from each chunk's first boundary on
            state[go[i]] = START
            got = self.step(state, grid[i])
            state = (got >> 8).astype(np.int64)
            out[i] = (got & 255) - BIAS
        through = ~go.any(axis=0)
        head = np.where(through, LANE, go.argmax(axis=0))
        head[-1] = min(head[-1], n - (lanes - 1) * LANE)
        todo, counts = self.head_counts(grid, head, through, state)
        out[head[todo] - 1, todo] = counts
        return out.T.reshape(-1)[:n]


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def rows_with(buf: np.ndarray, offs: np.ndarray, needles: list[bytes]) -> np.ndarray:
    """Documents of the chunk that hold one of the byte strings."""
    raw = buf.tobytes()
    found = []
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            found.append(at)
            at = raw.find(needle, at + 1)
    return np.unique(np.searchsorted(offs, found, "right") - 1).astype(np.int64)


def count_tokens(docs: DataFrame, limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor.
    A null text is empty and has 0 tokens; a null doc_id stays; repeated rows
    are counted each; other columns are ignored; an empty table gives none.
    Texts that hold a special token's string are left to the library, which
    takes it as that token.  No shuffle: one pass over the table.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        sizes = np.diff(offs)
        tokens = np.zeros(len(sizes), np.int64)
        if len(buf):
            total = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(fst.changes(buf, pretokens.starts(buf, offs)), out=total[1:])
            tokens = total[offs[1:]] - total[offs[:-1]]
            for d in rows_with(buf, offs, fst.special):
                tokens[d] = len(library(path).encode(buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return textvec.per_chunk(docs, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
