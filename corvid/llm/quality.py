"""Quality rules: repetition from suffix arrays, beside a few counts.

The words ``[^\\x20\\x09-\\x0D]+`` of a block of documents are ranked together; suffixes are sorted
by prefix doubling, in which only suffixes that still tie with another of their own document go
on. The ranks of all rounds give the longest common prefix of neighbours in the suffix array, and
so, for each position, the longest repeat that starts there: the right-maximal intervals of the
LCP array, of which no list is needed. A text fails when repeats of ``min_words`` words or more
cover over ``max_covered`` of its words, or when one repeat is longer than ``longest_words`` words,
however long the text. Both limits lie well within what the base rule lets pass (repeats of 8
words that cover up to 0.3).

Null and empty texts have no words, and so fail the base rule. Repeated rows are judged each for
itself; an empty table gives an empty result. Memory is bounded by a block (see blocks.py).
A null id is kept. A very long text is a block of its own. No column but the id and the text is looked at, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvid.llm import blocks as B

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RULES = {"min_words": 12, "max_covered": 0.1, "longest_words": 50}


def _ranked(keys: np.ndarray) -> np.ndarray:
    """For each key, the place (from 1) of the first equal one in sorted order."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) + 1
    return out


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on stand elsewhere in its document too (occurrences may overlap).

    ids: a 64-bit hash of each word, doc: its document, not falling.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    end = np.searchsorted(doc, doc, "right")
    rank = _ranked(B.mix(ids ^ B.mix(doc.astype(np.uint64) + np.uint64(1))))
    tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
    levels, width, live = [rank], 1, tied
    while len(live):
        full = levels[-1].copy()
        nxt = live + width
        second = np.where(nxt < end[live], full[np.minimum(nxt, n - 1)], 0)
        group = full[live]
        order = np.lexsort((second, group))
        g, s = group[order], second[order]
        at = np.arange(len(live))
        first = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], at, 0))
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]
        place = np.maximum.accumulate(np.where(new, at, 0))
        full[live[order]] = g + place - first
        size = np.diff(np.r_[np.flatnonzero(new), len(live)])
        live = live[order][np.repeat(size > 1, size)]
        levels.append(full)
        width *= 2
    sa = tied[np.argsort(levels[-1][tied], kind="stable")]
    a, b = sa[:-1], sa[1:]
    p, q, lcp = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    ok = doc[a] == doc[b]
    for k in range(len(levels) - 1, -1, -1):
        step, at = 1 << k, levels[k]
        same = ok & (p + step <= end[a]) & (q + step <= end[b])
        i = np.flatnonzero(same)
        i = i[at[p[i]] == at[q[i]]]
        lcp[i] += step
        p[i] += step
        q[i] += step
    best[a] = np.maximum(best[a], lcp)
    best[b] = np.maximum(best[b], lcp)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def judge(col: pa.Array, rules: dict = RULES) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for a block of texts."""
    data, off = B.flat(col)
    n = len(col)
    starts, ends, doc = B.words(data, off)
    n_words = B.per_doc(doc, n)
    before = B.chars_before(data)
    best = longest_repeats(B.hashes(data, starts, ends), doc)
    out = {"n_words": n_words, "word_chars": B.per_doc(doc, n, before[ends] - before[starts]).astype(np.int64)}
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marks[1:])
    out["n_symbols"] = marks[off[1:]] - marks[off[:-1]]

    breaks = np.flatnonzero(data == 10)
    l_start = np.sort(np.r_[off[:-1][off[:-1] < off[1:]], breaks[(breaks + 1) < len(data)] + 1]) if len(data) else np.zeros(0, np.int64)
    l_start = np.unique(l_start)
    l_doc = np.searchsorted(off, l_start, "right") - 1
    following = np.searchsorted(breaks, l_start)
    l_end = np.minimum(np.r_[breaks, len(data)][following], off[l_doc + 1]) if len(data) else l_start
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~B.WS[data], out=solid[1:])
    full = solid[l_end] > solid[l_start]
    l_key = B.mix(B.hashes(data, l_start[full], l_end[full]) ^ B.mix(l_doc[full].astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(l_key, return_index=True)
    repeated = np.ones(len(l_key), bool)
    repeated[first] = False
    out["n_dup_lines"] = B.per_doc(l_doc[full], n, repeated).astype(np.int64)

    w8 = np.flatnonzero(best >= 8)
    out["n_repeat_words"] = B.per_doc(doc[_covered(w8, np.full(len(w8), 8), len(doc))], n)
    long = np.flatnonzero(best >= rules["min_words"])
    out["covered_words"] = B.per_doc(doc[_covered(long, best[long], len(doc))], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, best)
    out["longest_repeat"] = longest
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    out["kept"] = ~(out["base_failed"] | (out["covered_words"] > rules["max_covered"] * n_words) | (longest > rules["longest_words"]))
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: dict = RULES) -> DataFrame:
    """One row per row of docs: its id and SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, text):
            out = judge(part.column(text), rules)
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(out[k]) for k in names)], names=[id_col, *names])

    docs = docs.select(id_col, text)
    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, text):
            yield part.filter(pa.array(judge(part.column(text), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
