"""URL filters: logistic regression on hashed character n-grams of host and path, and rules before it.

The model is fitted on the driver from a small labelled table of URLs (at most ``MAX_LABELLED``
rows, or the built-in table) and has ``BUCKETS`` weights, whatever the size of the input. URLs
are scored a block at a time with numpy.

The built-in table is made by rule and knows nothing of any table that is judged: subjects that
public block lists have categories for against everyday ones, in the same companions and places,
and shapes of addresses (numbers for a host, strings of digits and consonants, hyphens in a row,
programs and log-in forms as paths) against plain names. It stands in for a table of one's own.

A null URL, or one without ``://``, has an empty host and path; no rule fits it and the model
scores it as its bias alone. Of fitting rules of one length the greater text wins; each fits whole
labels of the host only. Long URLs are read whole, a very long one as a block of its own. Repeated
rows are judged each for itself; an empty table gives an empty result. No column but the id and the
URL is looked at, whatever its name; an id named like a column of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import blocks as B

BUCKETS, SIZES, MAX_LABELLED, ROUNDS, RIDGE = 1 << 14, (3, 4, 5), 50_000, 1500, 1e-5
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_BAD = """poker roulette jackpot baccarat sportsbook viagra cialis steroids escort hentai payday forex phishing malware botnet adware
spyware warez keygen torrents replica counterfeit scareware doorway clickbait popunder cracked serials hoax pyramid""".split()
_GOOD = """library news museum university gardening cooking travel council weather science history community school software docs archive
journal recipes photography music cycling astronomy theatre biology railways harbour forest mountain letters chess hospital parish
knitting physics language poetry charity football bakery pottery""".split()
_WITH = ("{}", "{}s", "{}-online", "best-{}", "the{}", "{}-group", "my{}", "{}hub", "{}-guide", "new-{}", "{}24", "{}-place")
_FRONT, _END = ("", "www.", "blog.", "m."), (".com", ".org", ".net", ".info", ".co.uk", ".eu")
_PATHS = ("", "/", "/index.html", "/about/history", "/p/88", "/2019/review.html", "/list/a-c", "/read")


def _names(rng: np.random.Generator, n: int) -> list[str]:
    """Names without a meaning, by rule: nothing speaks against them."""
    syllable = lambda: "bcdfghjklmnprstvw"[rng.integers(17)] * int(rng.random() < 0.8) + "aeiou"[rng.integers(5)] + "lnrst"[rng.integers(5)] * int(rng.random() < 0.4)
    return ["".join(syllable() for _ in range(rng.integers(2, 5))) for _ in range(n)]


def _suspects(rng: np.random.Generator, n: int) -> list[str]:
    """Addresses whose shape speaks against them: host and path."""
    mixed = lambda k: "".join("bcdfghjklmnpqrstvwxz0123456789"[rng.integers(30)] for _ in range(k))
    ends = ("/verify/account.php", "/secure-login/", "/update/setup.exe", "/get.apk", "/gate.php", "/wp-includes/signin/confirm")
    out = []
    for k in range(n):
        numbers, hyphens = ".".join(str(rng.integers(1, 255)) for _ in range(4)), "-".join([*_names(rng, 4), str(rng.integers(100, 9999))])
        hosts = numbers, mixed(rng.integers(10, 20)) + ".info", hyphens + ".com", "xn--" + mixed(8) + ".net"
        out.append(hosts[k % 4] + ends[rng.integers(len(ends))])
    return out


def seed(subjects: slice = slice(None), random_seed: int = 11) -> list[tuple[str, int]]:
    """A small labelled table: (url, 1 to block); from some of the subjects, so that the others can be held out."""
    rng = np.random.default_rng(random_seed)
    names = [(form.format(x), label) for words, label in ((_BAD, 1), (_GOOD, 0)) for x in words[subjects] for form in _WITH] + [(x, 0) for x in _names(rng, 360)]
    urls = [(f"https://{_FRONT[k % 4]}{name}{_END[k % 6]}{_PATHS[k % 8]}", label) for k, (name, label) in enumerate(names)]
    return urls + [(f"http://{x}", 1) for x in _suspects(rng, 360)]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram, and the weight of each text's n-grams; texts are host, line feed, path."""
    data, off = B.flat(col)
    n_docs = len(col)
    doc_of = np.repeat(np.arange(n_docs), np.diff(off))
    seen = np.cumsum(data == 10)
    in_path = seen - np.r_[0, seen][off[:-1]][doc_of] > 0 if len(data) else np.zeros(0, bool)
    all_b, all_d = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + data[k : len(data) - n + 1 + k].astype(np.uint64)
        first, last = doc_of[: len(h)], doc_of[n - 1 :]
        ok = (first == last) & (in_path[: len(h)] == in_path[n - 1 :])
        h = B.mix(h * np.uint64(2) + in_path[: len(h)].astype(np.uint64))
        all_b.append((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int64))
        all_d.append(first[ok])
    b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (all_b, all_d))
    return b, d, 1 / np.sqrt(np.maximum(np.bincount(d, minlength=n_docs), 1))


def _score(col: pa.Array, w: np.ndarray, bias: float) -> np.ndarray:
    b, d, scale = features(col)
    return 1 / (1 + np.exp(-(np.bincount(d, w[b], minlength=len(col)) * scale + bias)))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parts(url: str) -> str:
    rest = url.split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate(_LOWER) + "\n" + tail[:end]


def train(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated gradient descent on the ridge-penalised log loss; the same for the same rows."""
    col = pa.array([_parts(u) for u, _ in labelled])
    y = np.array([k for _, k in labelled], float)
    b, d, scale = features(col)
    x = scale[d]
    w, v, bias, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(np.bincount(d, w[b] * x, minlength=len(y)) + bias)))
        g = (p - y) / len(y)
        v = 0.9 * v - 4.0 * (np.bincount(b, g[d] * x, minlength=BUCKETS) + RIDGE * w)
        vb = 0.9 * vb - 1.0 * g.sum()
        w, bias = w + v, bias + vb
    return w, float(bias)


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, score (the model's, from 0 to 1 for block).

    labelled: url, label (1 to block). Its first MAX_LABELLED rows by hash of the URL are used.
    """
    if id_col in ("host", "path", "rule", "verdict", "score"):
        raise ValueError(f"an id named {id_col} clashes with the result")
    rows = [(r[0], r[1]) for r in labelled.select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED).collect()] if labelled is not None else seed()
    w, bias = train(rows)
    weights = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(_score(part.column("feature"), weights, bias))], names=[*part.schema.names[:-1], "score"])

    df = pages.select(F.col(id_col).alias("id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    df = df.withColumn("feature", F.concat("host", F.lit("\n"), "path"))
    scored = df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, host string, path string, score double")
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
