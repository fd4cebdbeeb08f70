"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A document is a bag of shingles of five words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a shorter
text is one shingle). A shingle weighs its count times 1 + ln(1/f)/ln(1/F0), where f is the share of
distinct texts that hold it. Shares come from a count-min sketch of all texts, whose width is fixed
as its error is a share too; shares below ``F0``, about that error, count as ``F0``. The factor stays
between 1 and 2: with an unbounded one, the few edits within a large group of near copies would
outweigh all that the group shares, and its links would be lost.

1. Equal texts (up to case and white space) are one text from here on, known by a digest of its own.
2. Each text gets ``SAMPLES`` consistent weighted samples (h, t), equal in two texts with the chance
   of their weighted Jaccard similarity, and ``BANDS`` keys of four samples each.
3. A key's members are linked to its head, that which meets most others in all its keys. Every such
   pair is verified on the whole texts, and links of ``SIMILARITY`` or more make classes.
4. Similarity is not transitive: two members may be alike and not like their head. Such a pair must
   share what sets it apart from the head t. With W(x) the weight of a text, D(x) the weight of its
   changes against t, c = (1 - s) / (1 + s) for similarity s, and u(x) = D(x) - c W(x), x and y are alike
   only if their changes agree in (u(x) + u(y)) / 2 or more. In an order of all changes, rare ones first,
   the first change that they share leaves this much, itself included, to both of them. So a member is
   grouped by those of its changes alone that leave enough for some other that has the change too.
   Members of keys that are still in several classes are grouped anew by such changes. Groups of up to
   ``SMALL`` members are verified in full. In larger ones, of up to ``LISTED``, what is left to two members
   is held against u(x) and u(y) for every two, without their texts; the pairs that this leaves are verified
   if they are no more for each member than in a group of ``SMALL``, else those in none of them go. All other
   groups get a head of their own, against which all are verified, and those still in several classes are
   split by their changes against that head in turn, until no group is left. A group loses its head each
   time, so this ends, and no pair that shares a key is left out: it is verified, or in one class already,
   or ruled out by what it can share.

Classes are connected components, by rounds of label exchange over what is newly linked, written to the
shared folder. A pair at similarity 0.8 shares one of the 24 keys with a chance of about 0.999, at 0.9 of almost 1.

Null and empty texts are equal texts, and so one class. Rows without an id are classes of their own (class null).
Repeated rows share their class. Rows that share an id but not the text are told apart by their text: each
is in the class of its own text, so that two classes may be named by one id. An empty table gives an empty result,
very long texts are blocks of their own, and no column but the id and the text is looked at, whatever its name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm import blocks as B
from corvid.llm.shared import sized, written

WORDS, SIMILARITY = 5, 0.8
SAMPLES, ROWS, ARRANGED = 24, 4, 4
BANDS = ARRANGED * SAMPLES // ROWS
WIDTH, SLICES, F0 = 1 << 20, 128, 1 / 2048
#: Groups of at most so many members are verified pair by pair.
SMALL = 8
#: In groups of at most so many members those that may be alike by their numbers are listed; larger groups get a head at once.
LISTED = 4096
_TABLE = 1 << 16
_FOLD = bytes(B.LOWER)
#: Shingles that the sketch adds up at once.
_AT_ONCE = 2_000_000


def _draws() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gamma(2,1) draws, logarithms of others, and the samples in each band."""
    rng = np.random.default_rng(20)
    r = -np.log(rng.random(_TABLE) * rng.random(_TABLE))
    c = np.log(-np.log(rng.random(_TABLE) * rng.random(_TABLE)))
    bands = [b for _ in range(ARRANGED) for b in rng.permutation(SAMPLES).reshape(-1, ROWS)]
    return r.astype(np.float32), c.astype(np.float32), bands


R, LN_C, BAND = _draws()


def digests(col: pa.Array) -> list[bytes]:
    """16 bytes of the SHA-256 of each text, A-Z lower-cased and white space as single spaces."""
    data, off = B.flat(col)
    whole = data.tobytes().translate(_FOLD)
    return [hashlib.sha256(b" ".join(whole[i:j].split())).digest()[:16] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document (not falling), hash, count."""
    data, off = B.flat(col)
    data = B.LOWER[data]
    starts, ends, doc = B.words(data, off)
    h = B.hashes(data, starts, ends)
    n = B.per_doc(doc, len(col))
    first = np.cumsum(n) - n
    length = np.minimum(n[doc], WORDS) if len(doc) else n[:0]
    keep = np.arange(len(h)) - first[doc] <= n[doc] - length
    at, length = np.flatnonzero(keep), length[keep]
    key = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = k < length
        key[inside] = B.mix(key[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + k])
    order = np.lexsort((key, doc[at]))
    d, key = doc[at][order], key[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (key[1:] != key[:-1])]) if len(d) else np.zeros(0, np.int64)
    return d[new], key[new], np.diff(np.r_[new, len(d)])


def _cells(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(WIDTH - 1)
    return (key & m).astype(np.int64), ((key >> np.uint64(40)) & m).astype(np.int64)


def document_shares(texts: DataFrame, text: str) -> np.ndarray:
    """IDF factors by cell of the sketch, two rows of WIDTH."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, waiting = np.zeros((2, WIDTH), np.uint32), 0, []

        def add_up() -> None:
            if waiting:
                for row, cell in zip(seen, _cells(np.concatenate(waiting)), strict=True):
                    row += np.bincount(cell, minlength=WIDTH).astype(np.uint32)
                waiting.clear()

        for part in B.blocks(batches, text):
            waiting.append(shingles(part.column(text))[1])
            n += part.num_rows
            if sum(map(len, waiting)) >= _AT_ONCE:
                add_up()
        add_up()
        if n:
            raw = [pa.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for x in seen.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(raw, pa.binary()), pa.array([n] * SLICES, pa.int64())], names=["k", "raw", "n"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = 2 * WIDTH // SLICES
        total, n = np.zeros(cells, np.float64), 0
        for part in batches:
            for raw, m in zip(part.column("raw").to_pylist(), part.column("n").to_pylist(), strict=True):
                planes = np.frombuffer(pa.decompress(raw, 4 * cells, "zstd", asbytes=True), np.uint8)
                total += np.ascontiguousarray(planes.reshape(4, cells).T).view(np.uint32).reshape(cells)
                n += m
        share = (total / n).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([share], pa.binary())], names=["k", "raw"])

    rows = texts.select(text).mapInArrow(count, "k int, raw binary, n long").groupBy("k").applyInArrow(add, "k int, raw binary").collect()
    share = np.zeros((SLICES, 2 * WIDTH // SLICES), np.float32)
    for r in rows:
        share[r["k"]] = np.frombuffer(r["raw"], np.float32)
    share = share.reshape(2, WIDTH)
    # What other shingles put into a cell on average is taken off.
    share = np.maximum(share - share.mean(1, keepdims=True), F0)
    return (1 + np.log(1 / np.minimum(share, 1)) / math.log(1 / F0)).astype(np.float32)


def weights(key: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(key)
    # The smaller share is the better one of a count-min sketch: the larger factor.
    return count.astype(np.float32) * np.maximum(idf[0][a], idf[1][b])


def sample(col: pa.Array, idf: np.ndarray) -> np.ndarray:
    """SAMPLES numbers a document, 32 bits each; documents without words get zeros."""
    doc, key, count = shingles(col)
    out = np.zeros((len(col), SAMPLES), np.uint32)
    if not len(doc):
        return out
    ln_w = np.log(weights(key, count, idf))
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[new, len(doc)])
    for i in range(SAMPLES):
        h = (key ^ np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        r = R[(h >> np.uint64(48)).astype(np.int64)]
        beta = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / _TABLE)
        t = np.floor(ln_w / r + beta)
        ln_a = LN_C[((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        least = np.minimum.reduceat(ln_a, new)
        at = np.flatnonzero(ln_a == np.repeat(least, size))
        at = at[np.r_[True, doc[at][1:] != doc[at][:-1]]]
        out[doc[at], i] = (B.mix(key[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    for k, rows in enumerate(BAND):
        h = np.full(len(sig), k, np.uint64)
        for j in rows:
            h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j].astype(np.uint64))
        out[:, k] = h
    return out


def _both(a: pa.Array, b: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pair, shingle, weight in a and weight in b of all shingles of each pair of texts, by pair and shingle."""
    (da, ka, ca), (db, kb, cb) = shingles(a), shingles(b)
    d, k = np.r_[da, db], np.r_[ka, kb]
    w = np.r_[weights(ka, ca, idf), weights(kb, cb, idf)].astype(np.float64)
    in_b = np.r_[np.zeros(len(ka), bool), np.ones(len(kb), bool)]
    order = np.lexsort((k, d))
    d, k, w, in_b = d[order], k[order], w[order], in_b[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, np.int64)
    wa, wb = (np.add.reduceat(np.where(x, w, 0.0), new) if len(d) else w for x in (~in_b, in_b))
    return d[new], k[new], wa, wb


def similarity(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    d, _, wa, wb = _both(a, b, idf)
    both, either = (np.bincount(d, f(wa, wb), minlength=len(a)) for f in (np.minimum, np.maximum))
    return np.where(either > 0, both / np.maximum(either, 1e-30), 1.0)


def changes(a: pa.Array, b: pa.Array, idf: np.ndarray, least: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What sets b apart from a in each pair of texts: names of the changes, their sizes; D and u of b (see the top); whether b is unlike a."""
    n = len(a)
    d, k, wa, wb = _both(a, b, idf)
    size_a, size_b, both = (np.bincount(d, x, minlength=n) for x in (wa, wb, np.minimum(wa, wb)))
    diff = wb - wa
    some = np.abs(diff) > 1e-6 * np.maximum(wa, wb)
    d, size = d[some], np.abs(diff[some])
    name = B.mix(k[some] * np.uint64(2) + (diff[some] > 0).astype(np.uint64)).view(np.int64)
    total = np.bincount(d, size, minlength=n)
    u = total - (1 - least) / (1 + least) * size_b
    cut = np.cumsum(np.bincount(d, minlength=n))[:-1]
    return np.split(name, cut), np.split(size.astype(np.float32), cut), total, u, both < least * (size_a + size_b - both)


def components(links: DataFrame, name: str = "near-cc") -> DataFrame:
    """(id, class): the smallest id of the connected component of each id in links (a, b)."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("class")), name)
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("class").alias("m"))
        new = label.join(near, label.id == near.a).select("id", F.col("class").alias("old"), F.least("class", "m").alias("mid"))
        jump = label.select(F.col("id").alias("mid"), F.col("class").alias("up"))
        new = written(new.join(jump, "mid").select("id", "old", F.least("mid", "up").alias("class")), name)
        changed = new.where(F.col("old") != F.col("class")).limit(1).count()
        label = new.select("id", "class")
        if not changed:
            return label


def _pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of pairs whose texts ta and tb are bounded together."""
    for part in B.blocks(batches, "ta", B.BLOCK // 2):
        yield from B.blocks(iter([part]), "tb", B.BLOCK // 2)


class Linker:
    """Classes of texts by key, and the pairs that have been verified for them."""

    def __init__(self, texts: DataFrame, idf: np.ndarray, least: float) -> None:
        self.texts, self.least, spark = texts, least, texts.sparkSession
        self.shares = spark.sparkContext.broadcast(idf)  # two rows of WIDTH floats, whatever the input
        self.label = spark.createDataFrame([], "id binary, class binary")
        self.tested: DataFrame | None = None

    def with_texts(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ta, tb)."""
        one = pairs.select("a", "b").join(self.texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        return one.join(self.texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def classed(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with the class of their key, which is the key itself until it is linked."""
        return rows.join(self.label.select(F.col("id").alias(key), "class"), key, "left").withColumn("class", F.coalesce("class", key))

    def verify(self, pairs: DataFrame) -> None:
        """Verifies the pairs (x, y) that have not been, and joins the classes of those alike."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        shares, least = self.shares, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _pair_blocks(batches):
                alike = pa.array(similarity(part.column("ta"), part.column("tb"), shares.value) >= least)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(alike)

        links = written(self.with_texts(pairs).mapInArrow(run, "a binary, b binary"), "near-links")
        ends = self.classed(self.classed(links, "a").withColumnRenamed("class", "ca"), "b")
        ends = written(ends.where("ca != class").select(F.col("ca").alias("a"), F.col("class").alias("b")).distinct(), "near-ends")
        if not ends.limit(1).count():
            return
        # Only what is newly joined goes through the rounds: an edge for two classes, not for two texts.
        up = components(ends).withColumnRenamed("class", "up")
        new = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().join(self.label, "id", "left_anti")
        all_ = self.label.unionByName(new.withColumn("class", F.col("id")))
        all_ = all_.join(up.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("up", "class").alias("class"))
        self.label = written(all_, "near-label")

    def still_mixed(self, rows: DataFrame) -> DataFrame:
        """rows (g, b, ...), with class and n (rows of the group), of the groups g whose members b are of several classes."""
        rows = self.classed(rows, "b")
        hold = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
        return rows.join(hold.where("lo != hi").select("g", "n"), "g")


#: Whether members x and y, of different classes, can be alike by what is left to both from the change of their group on.
_MAY = "cx != cy AND 2 * least(lx, ly) >= ux + uy"


def _small(rows: DataFrame) -> DataFrame:
    """All pairs (x, y) in groups of at most SMALL rows that may be alike."""
    few = rows.where(F.col("n") <= SMALL)
    one, two = (few.select("g", F.col("b").alias(k), F.col("class").alias(f"c{k}"), F.col("left").alias(f"l{k}"), F.col("u").alias(f"u{k}")) for k in "xy")
    return one.join(two, "g").where(f"x < y AND {_MAY}").select("x", "y")


def _may_pairs(rows: DataFrame) -> DataFrame:
    """Of groups of several rows, the pairs (b, y) that may be alike, if they are no more for each row than in a group of SMALL; else the rows that may be alike to some other, y null."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        n, left, u = len(group), group.column("left").to_numpy(), group.column("u").to_numpy()
        of = group.column("class").combine_chunks().dictionary_encode().indices.to_numpy()
        found, size, some = [], np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(n):
            may = (of != of[i]) & (2 * np.minimum(left, left[i]) >= u + u[i])  # as _MAY
            size[i], some[i] = may[:i].sum(), may.any()
            if 2 * size.sum() <= (SMALL - 1) * n:
                found.append(np.flatnonzero(may[:i]))
        if len(found) == n:
            y = group.column("b").combine_chunks().take(pa.array(np.concatenate(found), pa.int64()))
            group = group.take(pa.array(np.repeat(np.arange(n), size), pa.int64()))
        else:
            group = group.filter(pa.array(some))
            y = pa.nulls(len(group), pa.binary())
        yield from group.append_column("y", y).combine_chunks().to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("g").applyInArrow(run, f"{kinds}, y binary")


def _open(rows: DataFrame, group: list[str], a: str, order: list[str]) -> DataFrame:
    """rows, with n, of the groups that may hold links between classes. Of groups of the same members and head a, one will do: the first in order, which leaves most."""
    # Of two members unlike the head both have the change among their first (p); those that have it further on meet members like the head alone.
    rows = rows.drop("n")
    ids, one = [F.xxhash64("b"), F.xxhash64("b", F.lit(1))], F.lit(1)
    said = {"n": (F.count, one), "lo": (F.min, F.col("class")), "hi": (F.max, F.col("class")), "s": (F.bit_xor, ids[0]), "t": (F.bit_xor, ids[1])}
    both = [f(x).alias(f"{k}_all") for k, (f, x) in said.items()] + [f(F.when(F.col("p"), x)).alias(f"{k}_p") for k, (f, x) in said.items()]
    hold = rows.groupBy(*dict.fromkeys([*group, a, *order])).agg(F.max(~F.col("unlike")).alias("kin"), *both)
    hold = hold.select(*dict.fromkeys([*group, a, *order]), "kin", *[F.when(F.col("kin"), F.col(f"{k}_all")).otherwise(F.col(f"{k}_p")).alias(k) for k in said]).where("lo != hi")
    hold = hold.groupBy(F.col(a).alias("of"), "n", "s", "t").agg(F.min_by(F.struct(*group, "kin"), F.struct(*order)).alias("one"))
    return rows.join(hold.select(*[f"one.{x}" for x in group], "one.kin", "n"), group).where("p OR kin").drop("kin")


def _by_changes(linker: Linker, rows: DataFrame) -> DataFrame:
    """(g, b, class, total, u, left, n): groups by change of the members b of groups, of rows (g, a, b), against their heads a, as far as they may hold links between classes; total: D; left: the size of the changes from that of the group on."""
    shares, least = linker.shares, linker.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pair_blocks(batches):
            names, sizes, *more = changes(part.column("ta"), part.column("tb"), shares.value, least)
            cols = [pa.array(names, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.float32())), *map(pa.array, more)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *cols], names=["a", "b", "names", "sizes", "total", "u", "unlike"])

    pairs = written(rows.select("a", "b").distinct(), "near-against")
    found = linker.with_texts(pairs).mapInArrow(run, "a binary, b binary, names array<bigint>, sizes array<float>, total double, u double, unlike boolean")
    found = linker.classed(written(found, "near-changes"), "b").select("a", "b", "class", "total", "u", "unlike", F.explode(F.arrays_zip(F.col("names").alias("e"), F.col("sizes").alias("size"))).alias("c"))
    found = found.select("a", "b", "class", "total", "u", "unlike", "c.e", "c.size")
    # Changes within one class do not count for links between classes.
    shared = found.groupBy("a", "e").agg(F.count("*").alias("df"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("u").alias("low"), F.min(F.when(F.col("unlike"), F.col("u"))).alias("low_unlike"))
    shared = shared.where("lo != hi").select("a", "e", "df", "low", F.coalesce("low_unlike", "low").alias("low_unlike"))
    # From the most frequent change on: what comes before a change in the order of rising frequency is not needed for what is left from it on.
    order = Window.partitionBy("a", "b").orderBy(F.desc("df"), F.desc("e"))
    found = found.join(shared, ["a", "e"]).withColumn("left", F.sum("size").over(order) + 1e-6 * F.greatest("total", F.lit(1.0)))
    found = found.withColumn("p", F.expr("2 * left >= u + low_unlike"))
    # A partner y of b shares D(y) = u(y) + c W(y) at most, where W(y) <= W(b) / least.
    further = F.col("unlike") & (2 * F.col("left") >= F.col("u") + F.col("low")) & (F.col("left") >= F.col("u") - (F.col("total") - F.col("u")) / least)
    found = written(found.where(F.col("p") | further).drop("size", "low", "low_unlike"), "near-changed")
    found = _open(found, ["a", "e"], "a", ["df", "e"]).drop("n")
    rows = rows.join(found, ["a", "b"]).withColumn("g", F.xxhash64("g", "e"))
    rows = _open(written(rows, "near-split"), ["g"], "a", ["df", "e", "g"])
    return written(rows.select("g", "b", "class", "total", "u", "left", "n"), "near-groups")


def _link(signed: DataFrame, linker: Linker) -> DataFrame:
    """(id, class) of the texts that are linked, by their keys."""
    where = signed.select("key", F.explode("keys").alias("band"))
    several = where.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    where = written(where.join(several, "band"), "near-bands")
    rank = where.groupBy("key").agg(F.sum("n").alias("rank"))
    head = F.max_by("key", F.struct("rank", -F.hash("key"), "key")).alias("head")
    where = written(where.join(where.join(rank, "key").groupBy("band").agg(head), "band").drop("n"), "near-heads")
    linker.texts = written(linker.texts.join(sized(written(rank.select("key"), "near-wanted"), 64), "key", "left_semi"), "near-texts")
    linker.verify(where.where("key != head").select(F.col("head").alias("x"), F.col("key").alias("y")))

    members = where.select(F.col("band").alias("g"), F.col("key").alias("b"), "head")
    mixed = linker.still_mixed(members).withColumns({"left": F.lit(0.0), "u": F.lit(0.0)})
    linker.verify(_small(written(mixed, "near-mixed")))
    # Keys of the same head are one group from here on.
    rows = linker.still_mixed(members).where((F.col("n") > SMALL) & (F.col("b") != F.col("head")))
    rows = written(rows.select(F.xxhash64("head").alias("g"), F.col("head").alias("a"), "b").distinct(), "near-members")
    while rows.limit(1).count():
        rows = _by_changes(linker, rows)
        listed = written(_may_pairs(rows.where((F.col("n") > SMALL) & (F.col("n") <= LISTED))), "near-may")
        pairs = listed.where("y is not null").select(F.col("b").alias("x"), "y")
        large = rows.where(F.col("n") > LISTED).unionByName(listed.where("y is null").drop("y"))
        # The member that is nearest to the former head is the next one.
        head = F.struct(F.col("b").alias("head"), F.col("class").alias("cx"), F.col("left").alias("lx"), F.col("u").alias("ux"))
        heads = large.groupBy("g").agg(F.min_by(head, F.struct("total", "b")).alias("h")).select("g", "h.*")
        large = written(large.withColumnsRenamed({"class": "cy", "left": "ly", "u": "uy"}).join(heads, "g"), "near-group-heads")
        met = large.where(_MAY).select(F.col("head").alias("x"), F.col("b").alias("y"))
        linker.verify(_small(rows).unionByName(pairs).unionByName(met))
        rows = linker.still_mixed(large.where("b != head").select("g", F.col("head").alias("a"), "b"))
        rows = written(rows.select("g", "a", "b"), "near-members")
    return linker.label


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """(id, key, class_id, class_size) of each row of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests(part.column("text")), pa.binary())], names=[*part.schema.names, "key"])

    def key_of(df: DataFrame) -> DataFrame:
        return df.select("id", "text").mapInArrow(keyed, f"id {kind}, text string, key binary")

    def only_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed(batches):
            yield part.select(["id", "key"])

    rows = written(docs.mapInArrow(only_key, f"id {kind}, key binary"), "near-rows")
    told = rows.where("id is not null")
    # One row stands for each text: that with its smallest id. Ids at several rows are told by their text as well.
    copies = written(told.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", "rep"), "near-copies")
    again = written(told.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "near-again")
    gone = told.join(sized(copies, 64), "key").where("id != rep").select("id").unionByName(again).distinct()
    texts = docs.where("id is not null").join(sized(written(gone, "near-copied"), 48), "id", "left_anti")
    if again.limit(1).count():
        mine = told.join(sized(again, 48), "id", "left_semi").select("key").distinct()
        first = told.join(mine, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
        more = key_of(docs.join(sized(again, 48), "id", "left_semi")).join(first, ["id", "key"], "left_semi")
        texts = texts.unionByName(written(more.dropDuplicates(["key"]), "near-more").select("id", "text"))

    linker = Linker(key_of(texts).select("key", "text"), document_shares(texts, "text"), least)
    shares = linker.shares

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, "text"):
            keys = band_keys(sample(part.column("text"), shares.value)).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(digests(part.column("text")), pa.binary()), keys], names=["key", "keys"])

    signed = written(texts.select("text").mapInArrow(sign, "key binary, keys array<bigint>"), "near-signatures")
    label = _link(signed, linker)
    found = rows.join(label.withColumnRenamed("id", "key"), "key", "left").select("id", "key", F.when(F.col("id").isNotNull(), F.coalesce("class", "key")).alias("class"))
    found = written(found, "near-classes")
    size = found.where("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    out = found.join(sized(written(size, "near-sizes"), 96), "class", "left")
    return out.select("id", "key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), class_size, kept (whether it is that one)."""
    out = _classes(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), least)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs without those that are near copies of a kept one, with its own columns; rows that share id and text all stay or go."""
    cols = docs.columns
    id_col, text = (f"c{cols.index(x)}" for x in (id_col, text))
    docs = docs.toDF(*[f"c{k}" for k in range(len(cols))])  # whatever the columns are named
    found = written(_classes(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), least).where("id is not null"), "near-found")
    gone = found.where("id != class_id").select(F.col("id").alias(id_col)).distinct()
    kept = docs.join(sized(written(gone, "near-gone"), 48), id_col, "left_anti")
    # Ids of which one row goes and another, with another text, stays.
    split = written(found.where("id = class_id").select(F.col("id").alias(id_col), "key").join(gone, id_col, "left_semi").distinct(), "near-split")
    if split.limit(1).count():
        kind = docs.schema

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield part.append_column("key", pa.array(digests(part.column(text)), pa.binary()))

        rows = docs.join(split.select(id_col).distinct(), id_col, "left_semi").select(*docs.columns)
        rows = rows.mapInArrow(keyed, type(kind)([*kind.fields, *split.select("key").schema.fields])).join(split, [id_col, "key"], "left_semi")
        kept = kept.select(*docs.columns).unionByName(rows.select(*docs.columns))
    return kept.select(*docs.columns).toDF(*cols)
