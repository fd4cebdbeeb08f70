"""BPE encoding and decoding with reuse of content-defined chunks.

A hash rolling over the last eight bytes cuts each text into chunks, so that a passage that
many documents share is cut alike in all of them. A chunk's *core*, from its first to its last
place where a printable ASCII character meets a space or a line feed, encodes alike whatever
stands around it: no pre-token runs across such a place. Each core is encoded once per worker and
kept with its ids, their digits and the decoded bytes (the cache holds ``CACHE`` bytes and starts
anew when full). What lies between the cores, the join, is encoded anew from one core to the next;
a chunk without such a place falls into the join whole, so that a join grows until it agrees on
both sides, over a whole text at worst. Special tokens that stand in a text split it first, as the
tokenizers library does, and give their own ids; the parts between them are cut into chunks like any text.

Null counts as empty: no ids, an empty decoded text. Null ids are kept. Repeated rows are encoded each for itself
(out of the cache); a very long text is a block of its own; an empty table gives an empty result. No column but
the id and the text is looked at, whatever its name.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvid.llm import blocks as B

MULT, SHIFT, CACHE = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 10), 96 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_codecs: dict[str, Codec] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encodes texts with the vocabulary of a byte-level tokenizers file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}
        self.bytes = {i: bytes(to_byte[c] for c in tok) for tok, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The order of merges is the order of ids in such a vocabulary; checked here, as the encoder goes by ids.
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(x)] for x in merges]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("ids do not follow the merges")
        special = set(self.special.values())
        ranks = {b: i for i, b in self.bytes.items() if i not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        if sorted(self.bytes) != list(range(len(self.bytes))):
            raise ValueError("ids leave gaps")
        self.bytes = [self.bytes[i] for i in range(len(self.bytes))]
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.cache: dict[bytes, tuple[int, str, bytes, array]] = {}
        self.held = 0

    def piece(self, raw: bytes, keep: bool) -> tuple[int, str, bytes, array]:
        """Number of ids, their digits, the decoded bytes, the ids."""
        if not raw:
            return 0, "", b"", array("i")
        if (got := self.cache.get(raw)) is None:
            ids = self.encode(raw.decode())
            got = len(ids), ",".join([self.digits[i] for i in ids]), b"".join([self.bytes[i] for i in ids]), array("i", ids)
            if keep:
                self.held += 400 + 14 * len(raw)
                if self.held > CACHE:
                    self.cache, self.held = {}, 0
                self.cache[raw] = got
        return got

    def text(self, raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, str, bytes, array]]:
        """The pieces of a text; cuts: start and end of the cores."""
        out, at = [], 0
        for a, b in cuts:
            out += [self.piece(raw[at:a], False), self.piece(raw[a:b], True)]
            at = b
        return [*out, self.piece(raw[at:], False)]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cores(data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text, start and end of its chunks' cores, from the text's start."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(off) - 1)]
    if len(data) < 2:
        return out
    safe = np.flatnonzero((data[:-1] > 32) & (data[:-1] < 127) & ((data[1:] == 32) | (data[1:] == 10))) + 1
    doc = np.searchsorted(off, safe, "right") - 1
    at_start = safe == off[doc]
    safe, doc = safe[~at_start], doc[~at_start]
    window = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))
    cut = np.flatnonzero((window * MULT) >> SHIFT == 0) + 8
    bounds = np.unique(np.r_[off, cut])
    chunk = np.searchsorted(bounds, safe, "left")
    if not len(safe):
        return out
    new = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    last = np.r_[new[1:], len(safe)] - 1
    for d, a, b in zip(doc[new].tolist(), safe[new].tolist(), safe[last].tolist(), strict=True):
        if b > a:
            o = int(off[d])
            out[d].append((a - o, b - o))
    return out


def encode_block(col: pa.Array, c: Codec) -> Iterator[list[tuple[int, str, bytes, array]]]:
    data, off = B.flat(col)
    whole = data.tobytes()
    marks = [s.encode() for s in c.special]
    for k, cuts in enumerate(cores(data, off)):
        raw = whole[off[k] : off[k + 1]]
        if any(m in raw for m in marks):
            got = []
            for part in c.split.split(raw.decode()):
                if (i := c.special.get(part)) is None:
                    own = part.encode()
                    got += c.text(own, cores(np.frombuffer(own, np.uint8), np.array([0, len(own)]))[0])
                else:
                    got.append((1, str(i), part.encode(), array("i", [i])))
            yield got
        else:
            yield c.text(raw, cuts)


def bpe(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of docs: id, ids, decoded; with ``digests`` their SHA-256 and number instead."""
    path = path or vocabulary("byte_bpe_50k.json")
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in B.blocks(batches, text, 1_000_000):
            if digests:
                n, ids, dec = [], [], []
                for got in encode_block(part.column(text), c):
                    n.append(sum(x[0] for x in got))
                    ids.append(hashlib.sha256(",".join([x[1] for x in got if x[1]]).encode()).hexdigest())
                    dec.append(hashlib.sha256(b"".join([x[2] for x in got]).decode(errors="replace").encode()).hexdigest())
                cols = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                got = list(encode_block(part.column(text), c))
                cols = [pa.array([[i for x in g for i in x[3]] for g in got], pa.list_(pa.int32())), pa.array([b"".join([x[2] for x in g]).decode(errors="replace") for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *cols], names=[id_col, "ids", "decoded"])

    docs = docs.select(id_col, text)
    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {kinds}")
