"""LM scoring by deleted interpolation of n-gram estimates.

P(w | v) = a_b c(v,w)/c(v) + b_b c(w)/N + g_b 1/(V+1), with weights for each bucket b of the
context's frequency c(v) (powers of two). The weights come from expectation-maximisation on held-out
counts: each training event is held out in turn, that is, one is deleted from its own counts, and
all events of all training documents count. They meet in a histogram over (c(v,w)-1, c(v)-1, c(w)-1),
counts up to ``SAME`` each for itself and greater ones by half octaves (c(w) by octaves), which has
under 200,000 cells, whatever the input.

Counts are of the whole corpus, by 64-bit hashes of tokens and pairs. Documents are packed, in the order in
which they are read, into rows of about ``BATCH`` bytes of text, which are written once: neither an id nor
a text that many rows share makes a row large, only one very long document, which is a row of its own. Each
batch lists its distinct n-grams with its own training counts, dealt by hash to as many buckets as there are
batches; each bucket adds up, counts its distinct words and answers every batch. An n-gram, however frequent, is
one entry a batch. Such lists are one row for each batch and bucket, until a row holds one n-gram.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; the first token's
context is that end. Null and empty texts are one end token. A null id counts as the empty string
for the split. Repeated rows each count and are each scored; an empty table gives an empty result.
No column but the id and the text is looked at, whatever its name; an id named like a column of the
result is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import blocks as B
from corvid.llm.shared import written

BATCH, FOLDS, HELD = 4 << 20, 7, 2
END = np.uint64(0x5851F42D4C957F2D)
LEVELS, ROUNDS, FLOOR, SAME = 24, 60, 1e-5, 32


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed; their number in front."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(raw[8:], n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (even), hash of each token with its context (odd), and where each document's tokens start (one more at the end)."""
    data, off = B.flat(col)
    data = B.LOWER[data]
    starts, ends, doc = B.words(data, off)
    n = len(off) - 1
    size = B.per_doc(doc, n) + 1
    at = np.r_[0, np.cumsum(size)]
    one = np.empty(at[-1], np.uint64)
    one[np.arange(len(doc)) + doc] = B.hashes(data, starts, ends)
    one[at[1:] - 1] = END
    before = np.empty_like(one)
    before[1:] = one[:-1]
    before[at[:-1]] = END
    two = B.mix(before * np.uint64(0xD1342543DE82EF95) + one + np.uint64(0x9E3779B97F4A7C15))
    return one & ~np.uint64(1), two | np.uint64(1), at


def _keys(texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their training counts, for each token the place of itself and of its pair, and the tokens of each document."""
    parts = [tokens(x.column("text")) for x in B.blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))]
    one, two, sizes = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([np.diff(x[2]) for x in parts])
    keys, which = np.unique(np.r_[one, two], return_inverse=True)
    train = np.repeat(~held, sizes)
    counts = np.bincount(which, np.r_[train, train].astype(float), minlength=len(keys)).astype(np.uint32)
    return keys, counts, which[: len(one)], which[len(one) :], sizes


def _cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return bucket[start].astype(np.int64), np.r_[start, len(keys)]


def packed(docs: DataFrame, id_col: str, text: str, most: int) -> DataFrame:
    """(batch, ids, held, lengths, raw): a row for about ``most`` bytes of text, compressed."""

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, batch = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            data, off = B.flat(table.column("text"))
            raw = pa.Codec("zstd", 1).compress(data.tobytes(), asbytes=True)
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
            cols = [pa.array([batch]), whole(table.column("id")), whole(table.column("held")), whole(pa.array(np.diff(off))), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["batch", "ids", "held", "lengths", "raw"])

        for part in B.blocks(batches, "text", most):
            waiting.append(part)
            size += part.column("text").nbytes
            if size >= most:
                yield row()
                waiting, size, batch = [], 0, batch + 1
        if waiting:
            yield row()

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.crc32(key.cast("binary")) % FOLDS == HELD).alias("held"))
    kind = docs.schema[id_col].dataType.simpleString()
    return written(rows.mapInArrow(pack_up, f"batch long, ids array<{kind}>, held array<boolean>, lengths array<long>, raw binary"), "lm-packed")


def _unpacked(part: pa.RecordBatch | pa.Table, k: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and held of a packed row."""
    sizes = np.array(part.column("lengths")[k].values, np.int64)
    raw = pa.Codec("zstd").decompress(part.column("raw")[k].as_py(), int(sizes.sum()), asbytes=True)
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes()), pa.py_buffer(raw))
    return texts, np.array(part.column("held")[k].values.to_pylist(), bool)


def _counted(docs: DataFrame, id_col: str, text: str, most: int) -> tuple[DataFrame, int]:
    """A row for each batch: its ids, whether they are held out, tokens of each, and the training counts of each token and pair; and the number of distinct training words."""
    batches = packed(docs, id_col, text, most)
    n = max(1, batches.count())

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                keys, counts, *_ = _keys(*_unpacked(part, k))
                bucket, cut = _cuts(keys, n)
                lists = [(pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = [pa.array(bucket, pa.int64()), pa.array([part.column("batch")[k].as_py()] * len(lists), pa.int64()), *(pa.array([x[j] for x in lists], pa.binary()) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "batch", "keys", "counts"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts).astype(float)).astype(np.uint64)
        words = int(np.count_nonzero(total[found & np.uint64(1) == 0]))
        total = total[which]
        ends = np.cumsum([len(x) for x in keys])
        parts = [pack(total[e - len(x) : e]) for x, e in zip(keys, ends, strict=True)]
        seen = pa.array([words] + [0] * (len(parts) - 1), pa.int64())
        return pa.table({"batch": table.column("batch").cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()), "totals": pa.array(parts, pa.binary()), "words": seen})

    def align(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, one, two, sizes = _keys(*_unpacked(table.combine_chunks().to_batches()[0], 0))
        order = np.argsort(answers.column("bucket").to_numpy())
        blobs = answers.column("totals").to_pylist()
        total = np.concatenate([unpack(blobs[k], np.uint64) for k in order])
        return pa.table({"ids": table.column("ids"), "held": table.column("held"), "sizes": pa.array([sizes], pa.list_(pa.int64())), "ones": pa.array([pack(total[one])], pa.binary()), "twos": pa.array([pack(total[two])], pa.binary())})

    asked = batches.select("batch", "held", "lengths", "raw").mapInArrow(ask, "bucket long, batch long, keys binary, counts binary")
    answered = written(asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, totals binary, words long"), "lm-answers")
    words = answered.agg(F.sum("words")).first()[0] or 0
    out = f"ids array<{docs.schema[id_col].dataType.simpleString()}>, held array<boolean>, sizes array<long>, ones binary, twos binary"
    return batches.groupBy("batch").cogroup(answered.drop("words").groupBy("batch")).applyInArrow(align, out), words


def _read(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """held, sizes, starts, and for each token c(w), c(v,w), c(v)."""
    held = np.asarray(part.column("held")[k].as_py(), bool)
    sizes = np.asarray(part.column("sizes")[k].as_py(), np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    one, two = unpack(part.column("ones")[k].as_py(), np.uint64), unpack(part.column("twos")[k].as_py(), np.uint64)
    ctx = np.empty_like(one)
    ctx[1:] = one[:-1]
    ctx[at[:-1]] = one[at[1:] - 1]
    return held, sizes, at, one.astype(np.float64), two.astype(np.float64), ctx.astype(np.float64)


def _level(ctx: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(np.floor(np.log2(np.maximum(ctx, 0.5))).astype(np.int64) + 1, LEVELS - 1)


def _step(x: np.ndarray, width: int = 2) -> np.ndarray:
    """Counts up to SAME are steps of their own, greater ones by parts of an octave."""
    return np.where(x <= SAME, x, SAME + np.round(width * np.log2(np.maximum(x, SAME) / SAME))).astype(np.int64)


def _value(step: np.ndarray, width: int = 2) -> np.ndarray:
    return np.where(step <= SAME, step, SAME * 2.0 ** ((step - SAME) / width))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for k in range(part.num_rows):
            held, sizes, _, one, two, ctx = _read(part, k)
            train = np.repeat(~held, sizes)
            one, two, ctx = one[train], two[train], ctx[train]
            found, n = np.unique((_step(two - 1) * 1024 + _step(ctx - 1)) * 1024 + _step(one - 1, 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, -1]), pa.array(np.r_[n, len(one)].astype(np.float64))], names=["cell", "n"])


def fit(cells: dict[int, float], n_tokens: float, n_words: float) -> np.ndarray:
    """Weights (pair, word, any) of each level, by expectation-maximisation; levels without events take those of the level below."""
    key = np.array(sorted(cells), np.int64)
    n = np.array([cells[k] for k in key], float)
    one, ctx, two = _value(key % 1024, 1), _value(key // 1024 % 1024), _value(key // 1024**2)
    level = _level(ctx)
    p = np.stack([np.minimum(two / np.maximum(ctx, 1), 1), one / max(n_tokens - 1, 1), np.full(len(key), 1 / (n_words + 1))])
    weights = np.full((LEVELS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = p * weights[level].T
        share *= n / share.sum(0)
        total = np.stack([np.bincount(level, s, minlength=LEVELS) for s in share], 1)
        has = total.sum(1) > 0
        weights[has] = total[has] / total[has].sum(1, keepdims=True)
    weights = np.maximum(weights, FLOOR)
    weights /= weights.sum(1, keepdims=True)
    seen = np.bincount(level, minlength=LEVELS) > 0
    for k in range(1, LEVELS):
        if not seen[k]:
            weights[k] = weights[k - 1]
    # An unseen context gives no pair estimate: its weight goes to the others.
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def lm_score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10)."""
    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if id_col in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"):
        raise ValueError(f"an id named {id_col} clashes with the result")
    counted, n_words = _counted(docs, id_col, text, batch)
    counted = written(counted, "lm-counts")
    cells = {r["cell"]: r["n"] for r in counted.mapInArrow(_histogram, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n_tokens = round(cells.pop(-1, 0.0))
    weights = fit(cells, n_tokens, n_words)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(part.num_rows):
                held, sizes, at, one, two, ctx = _read(part, k)
                w = weights[_level(ctx)]
                p = w[:, 0] * two / np.maximum(ctx, 1) + w[:, 1] * one / max(n_tokens, 1) + w[:, 2] / (n_words + 1)
                base = np.log10(one + 1) - math.log10(n_tokens + n_words + 1)
                per = [np.add.reduceat(x, at[:-1]) for x in (one > 0, base, np.log10(p))]
                ids = part.column("ids")[k].values
                cols = [ids, pa.array(held), pa.array(sizes), pa.array(per[0].astype(np.int64)), pa.array(np.full(len(held), n_tokens, np.int64)), pa.array(per[1]), pa.array(per[2])]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(score, schema)
