"""Byte-pair encoding and decoding with forced boundaries.

A merge makes a token of the vocabulary, so two neighbouring bytes that stand side
by side in no token can never end up in one token: between them is a certain cut.
The vocabulary gives a table of 256 x 256 byte pairs that occur inside some token;
every other pair in a text is cut, as is every edge of the published pre-token
pattern.  The fragments between cuts are encoded independently of one another,
each distinct one once, by the merges alone, and their ids are laid end to end.

Merges inside one fragment never look at another one: a merge takes the pair of
lowest rank, and pairs across a cut have no rank.  So the result is that of the
whole text, whatever the fragments' order.  A cut may fall inside a character; the
merges work on bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from . import pretokens, textvec
from .packing import Encoder
from .token_counts import byte_alphabet, rows_with


class FragmentCodec(Encoder):
    """Encoder of fragments between forced cuts, and the decoder of the same vocabulary."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        vocabulary = {s: i for s, i in spec["model"]["vocab"].items() if i not in added}
        token = {i: bytes(alphabet[c] for c in s) for s, i in vocabulary.items()} | {i: s.encode() for i, s in added.items()}
        self.inside = inner_pairs(b for i, b in token.items() if i not in added)
        #: the merges alone: no pattern, no special strings
        self.merges = Tokenizer(models.BPE(vocabulary, [tuple(m) for m in spec["model"]["merges"]]))
        self.letters = {b: c for c, b in alphabet.items()}
        self.named = {s.encode(): i for i, s in added.items()}
        self.specials = re.compile(b"|".join(re.escape(s) for s in sorted(self.named, key=len, reverse=True))) if self.named else None
        size = max(token) + 1
        self.token_length = np.array([len(token.get(i, b"")) for i in range(size)], np.int64)
        self.token_first = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        begin = pretokens.starts(buf, offs)
        begin[1:] |= ~self.inside[buf[:-1], buf[1:]]
        return begin

    def _encoded(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = raw.decode("latin-1").translate(self.letters)  # a character for each byte
        got = [e.ids for e in self.merges.encode_batch([text[a:b] for a, b in zip(start.tolist(), end.tolist())], add_special_tokens=False)]
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.uint32)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and each document's offset; special strings are their tokens."""
        found = []  # (start, end) of special strings
        for d in rows_with(buf, offs, self.special) if self.specials else ():
            found += [(offs[d] + m.start(), offs[d] + m.end()) for m in self.specials.finditer(buf[offs[d] : offs[d + 1]].tobytes())]
        if not found:
            return self.ids(buf, offs)
        edges = np.unique(np.concatenate((offs, np.array(found).reshape(-1))))
        ids, at = self.ids(buf, edges)
        length = np.diff(at)
        whole = np.searchsorted(edges, [a for a, _ in found])
        keep = np.ones(len(ids), bool)
        keep[textvec.ragged(at[:-1][whole] + 1, length[whole] - 1)] = False
        ids = ids.copy()
        ids[at[:-1][whole]] = [self.named[buf[a:b].tobytes()] for a, b in found]
        length[whole] = 1
        total = np.concatenate(([0], np.cumsum(length)))
        return ids[keep], total[np.searchsorted(edges, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the decoded text; what is no UTF-8 becomes the replacement character."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.token_length)):
            raise ValueError("an id that the vocabulary does not have")
        raw = self.token_bytes[textvec.ragged(self.token_first[ids], self.token_length[ids])].tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def inner_pairs(tokens: Iterator[bytes]) -> np.ndarray:
    """Whether the second byte follows the first one inside some token."""
    inside = np.zeros((256, 256), bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


@lru_cache(2)
def codec(path: str) -> FragmentCodec:
    return FragmentCodec(path)


def _path(tokenizer: str | None) -> str:
    return tokenizer or public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token ids of every whole text: doc_id, ids.

    ``tokenizer`` is the path of a byte-level BPE file with the published split
    pattern, readable on every executor.  Special strings in a text are their tokens,
    as the library has it; none are added.  A null text is empty and has no ids; a
    null doc_id stays; repeated rows are encoded each; an empty table gives none;
    other columns are ignored.  One pass, no shuffle.
    """
    path = _path(tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, at = codec(path).encode(buf, offs)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["doc_id", "ids"])

    return textvec.per_chunk(docs, run, f"doc_id {kind}, ids array<int>")


def _decoded(encoded: DataFrame, tokenizer: str | None, schema: str, row) -> DataFrame:
    """doc_id and what ``row(codec, ids)`` makes of each row's ids; null ids are none."""
    path = _path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.keep_freed_memory()
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            made = [row(codec(path), flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*made))] if made else [batch.column(0), *(pa.array([], pa.null()) for _ in names)], ["doc_id", *names])
        textvec.release()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, {schema}")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Texts of token ids: doc_id, text of ``encoded(doc_id, ids)``; special tokens are not skipped.

    Null ids are none and give an empty text; an id that the vocabulary does not have
    is an error; an empty table gives none; other columns are ignored.
    """
    return _decoded(encoded, tokenizer, "text string", lambda c, ids: (c.decode(ids).decode(),))


def digest(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encoded(doc_id, ids)``."""

    def row(c: FragmentCodec, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _decoded(encoded, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
