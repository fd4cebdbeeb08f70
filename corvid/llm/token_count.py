"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary is a byte trie. Each node has a failure link and the number of tokens that are
popped on the way along it, both computed once, breadth first: a node that is a token pops itself
and fails to the root; another one pops what its parent pops, and more while the failed nodes lack
the next byte. Reading a word then costs one step a byte plus pops that never exceed the tokens.

A word is a run ``[^\\x20\\x09-\\x0D]+``; its first piece is looked up with the space mark that
byte-level vocabularies put before words, the further pieces without it. Only distinct words of a
block are read. Null and empty texts have no words and no tokens; repeated rows count each for
itself; an empty table gives an empty result.
A null id is kept. A very long text is a block of its own. No column but the id and the text is looked at, whatever its name.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvid.llm import blocks as B
from corvid.llm.bpe import vocabulary

_automata: dict[str, Automaton] = {}


def pieces(path: str) -> set[bytes]:
    """The byte strings of a byte-level vocabulary that can stand in a word: a space only in front."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}
    found = {bytes(to_byte[c] for c in tok) for tok in vocab}
    return {x for x in found if x and b" " not in x[1:]}


class Automaton:
    def __init__(self, vocab: set[bytes]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in vocab]
        if missing:
            raise ValueError("the vocabulary lacks single bytes, so some words would have no pieces")
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for word in sorted(vocab):
            v = 0
            for b in word:
                if b not in self.next[v]:
                    self.next[v][b] = len(self.next)
                    self.next.append({})
                    token.append(False)
                v = self.next[v][b]
            token[v] = True
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                if token[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    # The root has every byte, so that this ends; it is reached by popping only.
                    z, n = self.fail[u], self.pops[u]
                    while b not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = self.next[z][b], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for b in word:
            while b not in nxt[v]:
                n += pops[v]
                v = fail[v]
            v = nxt[v][b]
        while v:
            n += pops[v]
            v = fail[v]
        return n


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(pieces(path))
    return _automata[path]


def count_block(col: pa.Array, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    data, off = B.flat(col)
    starts, ends, doc = B.words(data, off)
    _, first, which = np.unique(B.hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    n = np.fromiter((a.count(b" " + raw[s:e]) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.int64, len(first))
    return B.per_doc(doc, len(col)), B.per_doc(doc, len(col), n[which] if len(which) else np.zeros(0)).astype(np.int64)


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_tokens."""
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for part in B.blocks(batches, text):
            n_words, n_tokens = count_block(part.column(text), a)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n_words), pa.array(n_tokens)], names=[id_col, "n_words", "n_tokens"])

    docs = docs.select(id_col, text)
    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long")
