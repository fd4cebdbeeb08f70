"""Queries against brute force, on edge cases and on a table of the test data."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from corvid.llm import bpe, lm_score, quality, queries, secrets, token_count, url_filter
from tests.llm.fixtures import EDGE, documents, write

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", params=["edge", "data", "empty"])
def table(request, spark, tmp_path_factory):
    if request.param == "data":
        if not Path(DATA).exists():
            pytest.skip("no test data here")
        return DATA
    return write(spark, tmp_path_factory.mktemp("t") / request.param, EDGE if request.param == "edge" else [])


def rows(spark, folder):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def brute_base(t: str) -> list[tuple[int, int, str, int]]:
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, table):
    got = queries.op3_secrets(spark, table).collect()
    want = []
    for d, t in rows(spark, table):
        base = brute_base(t)
        n = Counter(x[2] for x in base)
        want.append((d, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))))
    same([r[:5] for r in got], want)
    texts = defaultdict(list)
    for d, t in rows(spark, table):
        texts[d].append(t)
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda x: (int(x[1]), secrets.KINDS.index(x[0])))
        assert any({(k, a, b) for a, _, k, b in brute_base(t)} <= {(k, int(a), int(b)) for k, a, b in spans} for t in texts[r["doc_id"]])


def test_lm_base(spark, table):
    docs = rows(spark, table)
    toks = [[*WORD.findall(t.translate(LOWER)), None] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    want = [(d, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (d, _), h, t in zip(docs, held, toks, strict=True)]
    got = queries.op5_lm_score(spark, table).collect()
    same([r[:6] for r in got], want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def brute_quality(t: str) -> tuple:
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, table):
    got = queries.op6_quality(spark, table).collect()
    same([r[:7] for r in got], [(d, *brute_quality(t)) for d, t in rows(spark, table)])
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_longest_repeats_brute():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 40, 200):
        ids, doc = rng.integers(0, 3, size).astype(np.uint64), np.sort(rng.integers(0, 3, size))
        best = quality.longest_repeats(ids, doc)
        for i in range(size):
            most = 0
            for j in range(size):
                if i != j and doc[i] == doc[j]:
                    k = 0
                    while max(i, j) + k < size and doc[i + k] == doc[i] and doc[j + k] == doc[i] and ids[i + k] == ids[j + k]:
                        k += 1
                    most = max(most, k)
            assert best[i] == most


def test_bpe(spark, table):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    want = []
    for d, t in rows(spark, table):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    same(queries.op8_bpe(spark, table).collect(), want)
    plain = bpe.bpe(spark.read.parquet(f"{table}/documents.parquet")).collect()
    same([(r[0], len(r[1]), sha(",".join(map(str, r[1]))), sha(r[2])) for r in plain], want)


def test_token_counts(spark, table):
    path = bpe.vocabulary("byte_bpe_50k.json")
    vocab = token_count.pieces(path)
    longest = max(map(len, vocab))

    def greedy(word: bytes) -> int:
        n = i = 0
        while i < len(word):
            i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocab)
            n += 1
        return n

    want = [(d, len(w := WORD.findall(t)), sum(greedy(b" " + x.encode()) for x in w)) for d, t in rows(spark, table)]
    same(queries.op7_token_counts(spark, table).collect(), want)


def test_exact_dedup(spark, table):
    docs = [(d, sha(re.sub(r"[\x20\x09-\x0D]+", " ", t))) for d, t in rows(spark, table)]
    groups = defaultdict(list)
    for d, h in docs:
        groups[h].append(d)
    got = queries.op9_exact_dedup(spark, table).collect()
    keep = {h: min((x for x in v if x is not None), default=None) for h, v in groups.items()}
    same([(r[0], r[1], r[2], r[4]) for r in got], [(d, keep[h], len(groups[h]), h) for d, h in docs])
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) <= {1} and set(kept) == set(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET", "http://a.example.net/en/x?q#f", "http://a.example.net/fr/", "https://EXAMPLE.com/de/1", "https://example.com/de", "http://x.org/fr/1", "http://org/fr/", "http://notexample.com/de/", "ftp://net/", "net://a://b/c", "x://host?en/", "x://h#y://z", "x\ny://Ä.NET/\n?"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "x", "y", 1.0) for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, feature string, score double")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages).collect()}
    assert len(got) == len(URLS) * 2
    for k, u in enumerate(URLS * 2):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(LOWER), m[2]
        fits = [(len(r), r, w) for w, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        assert got[k]["rule"] == (max(fits)[1] if fits else None)
        assert got[k]["verdict"] == (max(fits)[2] if fits else "block" if got[k]["score"] > 0.5 else "allow")


def _url_accuracy(train: list, test: list) -> float:
    import numpy as np
    import pyarrow as pa

    w, bias = url_filter.train(train)
    p = url_filter._score(pa.array([url_filter._parts(u) for u, _ in test]), w, bias)
    return float(np.mean((p > 0.5) == np.array([y for _, y in test])))


def test_url_model_held_out():
    """On hosts and shapes that are not in the table, and on subjects that are not: the latter can only be known by what they are not."""
    table = url_filter.seed()
    other = [x for x in url_filter.seed(slice(0, 0), 12) if x not in table]
    assert _url_accuracy(table, other) > 0.9
    known = url_filter.seed(slice(0, None, 2))
    assert _url_accuracy(known, [x for x in table if x not in known]) > 0.5


def test_url_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter.url_filter(pages).count() == 0
    far = "http://a.org/" + "x" * 200_000
    got = url_filter.url_filter(spark.createDataFrame([(None, far), (None, far)], "page_id long, url string")).collect()
    assert [(r["page_id"], len(r["path"])) for r in got] == [(None, 200_001)] * 2
    with pytest.raises(ValueError, match="clashes"):
        url_filter.url_filter(spark.createDataFrame([(1, far)], "host long, url string"), id_col="host")


def test_url_labelled_table(spark):
    labelled = spark.createDataFrame([(f"http://{a}{k}.example.org/", y) for k in range(40) for a, y in (("alpha", 1), ("omega", 0))], "url string, label int")
    pages = spark.createDataFrame([(1, "http://alpha99.example.org/"), (2, "http://omega99.example.org/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages, labelled, rules=()).collect()} == {1: "block", 2: "allow"}


def test_random_battery():
    rng = random.Random(4)
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(300)]
    plain = [("averylongwordofordinarywriting" * 3)[k : k + 40] for k in range(20)] + ["some_function_name_with_parts_in_it", "0000000000000000000000000000", "2024-01-01-2024-01-02-2024-01-03", "abcabcabcabcabcabcabcabcabcabc"]
    at = secrets.thresholds([(0, int(secrets.battery(x)[2] * 10), 1) for x in keys + plain])
    hit = [secrets.battery(x)[1] and int(secrets.battery(x)[2] * 10) >= at[0] for x in keys + plain]
    assert sum(hit[:300]) > 285 and not any(hit[300:])


def test_secrets_random_spans(spark):
    key = base64.b64encode(random.Random(9).randbytes(30)).decode()
    rows = [(1, f"see {key} here"), (2, "nothing_but_ordinary_words_in_a_long_name here")]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(documents(spark, rows)).select("doc_id", secrets.as_text("spans").alias("spans")).collect()}
    assert got == {1: f"random:4:{4 + len(key)}", 2: ""}


def test_lm_better_than_base(spark):
    text = [" ".join(f"w{(7 * d + k) % 11} x{(7 * d + k) % 11}" for k in range(60)) for d in range(200)]
    got = lm_score.lm_score(documents(spark, list(enumerate(text)))).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def brute_lm(docs: list[tuple]) -> list[float]:
    """Scores by plain counts: the mixture's weights by the same expectation-maximisation over single events, each with one taken off its counts."""
    toks = [[None, *WORD.findall((t or "").translate(LOWER)), None] for _, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    pairs = [p for t, h in zip(toks, held, strict=True) if not h for p in zip(t, t[1:], strict=False)]
    two, one = Counter(pairs), Counter(w for _, w in pairs)
    n, v = sum(one.values()), len(one)
    level = lambda c: 0 if c < 1 else min(int(math.log2(c)) + 1, lm_score.LEVELS - 1)
    events = Counter((two[p] - 1, one[p[0]] - 1, one[p[1]] - 1) for p in pairs)
    w = [[1 / 3] * 3 for _ in range(lm_score.LEVELS)]
    for _ in range(lm_score.ROUNDS):
        got = [[0.0] * 3 for _ in w]
        for (c2, c1, c0), k in events.items():
            b = level(c1)
            p = [w[b][0] * min(c2 / max(c1, 1), 1), w[b][1] * c0 / max(n - 1, 1), w[b][2] / (v + 1)]
            for j in range(3):
                got[b][j] += k * p[j] / sum(p)
        w = [[x / sum(g) for x in g] if sum(g) else old for g, old in zip(got, w, strict=True)]
    w = [[max(x, lm_score.FLOOR) for x in r] for r in w]
    w = [[x / sum(r) for x in r] for r in w]
    seen = {level(c1) for _, c1, _ in events}
    for b in range(1, len(w)):
        w[b] = w[b] if b in seen else w[b - 1]
    w[0] = [0, *(x / sum(w[0][1:]) for x in w[0][1:])]
    score = lambda a, x: math.log10(w[level(one[a])][0] * two[a, x] / max(one[a], 1) + w[level(one[a])][1] * one[x] / max(n, 1) + w[level(one[a])][2] / (v + 1))
    return [sum(score(a, x) for a, x in zip(t, t[1:], strict=False)) for t in toks]


def test_lm_score_brute(spark):
    """Counts are small here, so that the histogram is exact; over several batches."""
    rng = random.Random(6)
    docs = [(d if d % 9 else None, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(12)))) for d in range(30)] + [(3, None), (3, "W1 w2"), (3, "W1 w2")]
    got = lm_score.lm_score(documents(spark, docs), batch=200).collect()
    want = sorted(((d, s) for (d, _), s in zip(docs, brute_lm(docs), strict=True)), key=lambda x: (str(x[0]), x[1]))
    got = sorted(((r["doc_id"], r["score"]) for r in got), key=lambda x: (str(x[0]), x[1]))
    assert len(got) == len(want) and all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_lm_probabilities_sum():
    """After any context the estimates of all words and of an unseen one come to 1."""
    import numpy as np

    w = lm_score.fit({(3 * 1024 + 9) * 1024 + 17: 5.0}, 1000, 50)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0
