"""Secret scans: named patterns, and a battery of randomness tests on long tokens.

A token is a run of 20 or more characters of ``[A-Za-z0-9+/_-]`` and its padding; its encoding (hex, base32,
base64) is the smallest alphabet that holds it. Three tests look at it: chi-squared for a uniform
use of the alphabet, the number of runs of one character class, and the correlation of neighbours.
Each gives a p-value for "drawn at random"; a token that one of them rejects at ``REJECT`` is no
secret. The first two also give a p-value for "written like words or numbers of that alphabet",
and Fisher's method combines them. These p-values, of all tokens of all documents, are held to
a false-discovery rate of ``FDR`` by Benjamini and Hochberg's rule within each encoding and length
band, as short tokens can't reach the small p-values of long ones and far outnumber them. The
p-values meet as counts in steps of 0.1 of their logarithm (rounded to the safe side), so that
what reaches the driver is bounded.

Spans are in code points, end exclusive. Null and empty texts have none. Repeated rows are scanned
each for itself; an empty table gives an empty result.
A null id is kept. A very long text is a block of its own. No column but the id and the text is looked at, whatever its name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import blocks as B
from corvid.llm.shared import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
FDR, REJECT = 0.01, 1e-4
#: Alphabet in order of value, and the chance that two characters of ordinary writing in it are the same.
ENCODINGS = (("hex", "0123456789abcdef", 0.12), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.068), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065))
#: How often the character class changes in ordinary writing.
CHANGES = 0.12
BANDS = (24, 32, 48, 64, 128)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the named patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> int:
    body = token.rstrip("=")
    if set(body) <= set("0123456789abcdef") or set(body) <= set("0123456789ABCDEF"):
        return 0
    return 1 if set(body) <= set(ENCODINGS[1][1]) else 2


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_tail(n: int, p: float, k: int) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k, n + 1)))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(token: str) -> tuple[int, bool, float]:
    """(encoding, whether no test rejects randomness, -log10 of the p-value for ordinary writing)."""
    enc = encoding(token)
    _, alphabet, same = ENCODINGS[enc]
    body = token.rstrip("=")
    body = body.lower() if enc == 0 else body.replace("-", "+").replace("_", "/")
    n, k = len(body), len(alphabet)
    if n < 8:
        return enc, False, 0.0
    value = [alphabet.find(c) for c in body]
    counts: dict[int, int] = {}
    for v in value:
        counts[v] = counts.get(v, 0) + 1
    x = sum(c * c for c in counts.values()) * k / n - n
    sd = math.sqrt(2 * (k - 1) * (1 - 1 / n))
    p_chi = _below(-(x - (k - 1)) / sd)
    # Ordinary writing: mean and spread of the same statistic when two characters agree with chance `same`.
    mean_o, sd_o = k * (1 + (n - 1) * same) - n, math.sqrt(2 * (k - 1) + 4 * n * max(k * same - 1, 0))
    o_chi = max(_below((x - mean_o) / sd_o), 1e-300)

    classes = [_class(c) for c in body]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    shares = {0: [(0, 10), (1, 6)], 1: [(0, 6), (2, 26)], 2: [(0, 10), (1, 26), (2, 26), (3, 2)]}[enc]
    change = 1 - sum((s / k) ** 2 for _, s in shares)
    z = (changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))
    p_runs = 2 * _below(-abs(z))
    o_runs = max(_binomial_tail(n - 1, CHANGES, changes), 1e-300)

    mean = sum(value) / n
    var = sum((v - mean) ** 2 for v in value)
    r = sum((a - mean) * (b - mean) for a, b in zip(value, value[1:], strict=False)) / var if var else 1.0
    p_serial = 2 * _below(-abs(r * math.sqrt(n) + 1 / math.sqrt(n)))

    half = -(math.log(o_chi) + math.log(o_runs))  # Fisher: twice this is chi-squared with 4 degrees of freedom
    p = math.exp(-half) * (1 + half) if half < 700 else 1e-300
    return enc, min(p_chi, p_runs, p_serial) >= REJECT, min(-math.log10(max(p, 1e-300)), 300.0)


def band(n: int) -> int:
    return sum(n >= b for b in BANDS)


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
TESTED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("random", pa.bool_()), ("step", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base array of (start, kind, end), tested array of (start, end, stratum, random, step)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, text):
            base, tested = [], []
            for t in part.column(text).to_pylist():
                t = t or ""
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)])
                found = []
                for m in TOKEN.finditer(t):
                    enc, random, p = battery(m[0])
                    found.append({"start": m.start(), "end": m.end(), "stratum": enc * 8 + band(len(m[0])), "random": random, "step": int(p * 10)})
                tested.append(found)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(base, pa.list_(SPAN)), pa.array(tested, pa.list_(TESTED))], names=[id_col, "base", "tested"])

    docs = docs.select(id_col, text)
    kinds = "base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,stratum:int,random:boolean,step:int>>"
    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {kinds}")


def thresholds(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """The least step that passes, by stratum, from (stratum, step, number of tokens)."""
    out: dict[int, int] = {}
    for s in {x[0] for x in counts}:
        steps = sorted(((step, n) for t, step, n in counts if t == s), reverse=True)
        total, above = sum(n for _, n in steps), 0
        for step, n in steps:
            above += n
            if 10 ** (-step / 10) <= fdr * above / total:
                out[s] = step
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of docs: id, base and spans, arrays of (start, kind, end) by start and kind; kinds are numbers in KINDS."""
    found = written(scan(docs, id_col, text), "secrets")
    tests = found.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").count()
    least = thresholds([(r[0], r[1], r[2]) for r in tests.collect()], fdr)
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.lit(None).cast("map<int,int>")

    def extra(x: Column) -> Column:
        hit = x["random"] & (x["step"] >= F.coalesce(limit[x["stratum"]], F.lit(1 << 30)))
        return hit & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    added = F.transform(F.filter("tested", extra), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return found.select(id_col, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def as_text(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
