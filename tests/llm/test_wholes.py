"""Near-dedup, mixing, HTML extraction and the pipeline, by small tables whose results are known."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from corvid.llm import exact_dedup, html_extract, mixing, near_dedup, quality, queries
from tests.llm.fixtures import EDGE, documents, prose, write


def edited(text: str, n: int, seed: int) -> str:
    rng, w = random.Random(seed), text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def brute_classes(docs: dict[int, str], least: float = 0.8) -> dict[int, int]:
    """Components of all pairs at weighted Jaccard similarity of `least`, with exact document shares."""
    bags = {}
    for d, t in docs.items():
        w = t.lower().split()
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()
    texts = {" ".join(t.lower().split()): d for d, t in docs.items()}
    df = Counter(s for d in texts.values() for s in bags[d])
    n = len(texts)
    wt = {d: {s: c * (1 + math.log(1 / max(df[s] / n, near_dedup.F0)) / math.log(1 / near_dedup.F0)) for s, c in b.items()} for d, b in bags.items()}
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = sum(min(v, wt[b].get(s, 0)) for s, v in wt[a].items())
            total = sum(wt[a].values()) + sum(wt[b].values()) - inter
            if (inter / total if total else 1.0) >= least:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in docs}


def test_near_dedup_brute(spark):
    docs, d = {}, 0
    for g in range(30):
        text = prose(100 + g, 60 + 20 * (g % 7))
        for k in range(1 + g % 4):
            docs[d := d + 1] = edited(text, 1 + k % 2, 31 * g + k) if k else text
    big = prose(999, 150)
    for k in range(40):  # a large group in which few are alike their smallest member
        docs[d := d + 1] = edited(big, 2, 5000 + k)
    docs |= {d + 1: "", d + 2: "  ", d + 3: "short", d + 4: "SHORT ", d + 5: "short one", d + 6: docs[1].upper(), d + 7: docs[1]}
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    want = brute_classes(docs)
    assert {k: r["class_id"] for k, r in got.items()} == want
    size = Counter(want.values())
    assert all(r["class_size"] == size[want[k]] and r["kept"] == (want[k] == k) for k, r in got.items())


def test_chain_is_one_class(spark):
    text = prose(7, 200).split(" ")
    chain = [" ".join([f"z{j}" if j < 5 * k else w for j, w in enumerate(text)]) for k in range(12)]
    docs = dict(enumerate(chain))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    assert got == brute_classes(docs) and set(got.values()) == {0}


def test_near_dedup_edges(spark):
    """Ids at several texts are told by the text; null ids stand alone; very long texts and repeated rows are whole; no rows give none."""
    a, b, c, long = prose(1, 60), prose(2, 200), edited(prose(2, 200), 1, 5), prose(3, 30_000)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, None), (4, long), (5, edited(long, 9, 1)), (6, None), (7, " \n"), (8, a.upper())]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"], r["kept"]) for r in near_dedup.near_dedup(documents(spark, rows)).collect())
    want = [(1, 1, 3, True), (2, 1, 3, False), (2, 2, 3, True), (3, 2, 3, False), (3, 2, 3, False), (None, None, 1, True), (None, None, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False), (8, 1, 3, False)]
    assert got == sorted((str(x[0]), str(x[1]), *x[2:]) for x in want)
    kept = near_dedup.keep_one(documents(spark, rows))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("1", a), ("2", b), ("None", a), ("None", ""), ("4", long), ("6", "")])
    assert kept.columns == documents(spark, []).columns
    assert near_dedup.near_dedup(documents(spark, [])).count() == 0


def test_links_between_members_unlike_their_head(spark):
    """Two families of near copies that share keys: classes as by brute force, though no head is like all members."""
    one = prose(11, 150)
    two = edited(one, 9, 77)
    docs = {k: edited(one if k % 2 else two, 1 + k % 4, 300 + k) for k in range(60)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    assert got == brute_classes(docs)


def linked(spark, docs: dict[int, str], keys: dict[int, list[int]]) -> dict[int, int]:
    """Classes, by smallest id, of texts with the keys given, all shingles weighing the same."""
    import numpy as np

    name = {d.to_bytes(16): d for d in docs}
    texts = spark.createDataFrame([(k, docs[d]) for k, d in name.items()], "key binary, text string")
    signed = spark.createDataFrame([(k, keys[d]) for k, d in name.items()], "key binary, keys array<bigint>")
    label = near_dedup._link(signed, near_dedup.Linker(texts, np.ones((2, near_dedup.WIDTH), np.float32), 0.8)).collect()
    of = {name[bytes(r["id"])]: bytes(r["class"]) for r in label}
    first: dict[bytes, int] = {}
    for d in sorted(of):
        first.setdefault(of[d], d)
    return {d: first[of[d]] if d in of else d for d in docs}


def test_groups_are_worked_off_when_a_round_links_nothing(spark):
    """Members of one key, of which the two that are alike share their changes with eight others that have more groups, and that are met first."""
    base, e, x = prose(21, 200), [3, 9, 15, 21], [30 + 8 * k for k in range(8)]

    def changed(**at: list[int]) -> str:
        w = base.split(" ")
        for tag, places in at.items():
            for j in places:
                w[j] = f"{tag}at{j}"
        return " ".join(w)

    docs = {0: base, 1: changed(e=e, own1=[100, 110]), 2: changed(e=e, own2=[120, 130]), 99: prose(22, 50)}
    docs |= {10 + k: changed(e=e, x=x, **{f"z{k}": [98 + 10 * k]}) for k in range(8)}
    docs |= {30 + k: changed(x=x, **{f"d{k}": [102 + 7 * k]}) for k in range(4)}
    want = {0: 0, 1: 1, 2: 1, 99: 99} | {10 + k: 10 for k in range(8)} | {30 + k: 30 for k in range(4)}
    assert linked(spark, docs, {d: [7] * (d != 99) + [8] * (d in (0, 99)) for d in docs}) == want


def test_rows_grow_with_the_members_of_a_group(spark, monkeypatch):
    """One large group of near copies, many of them unlike its head and each other: classes as by brute force, few pairs a member, and no member at every change that it shares with others."""
    made, write_out = Counter(), near_dedup.written

    def counted(df, name):
        out = write_out(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    docs = {k: edited(prose(23, 60), k % 5, 900 + k) for k in range(240)}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    assert got == brute_classes(docs)
    members = made["near-wanted"]
    assert members > 120 and made["near-pairs"] <= 4 * members and made["near-changed"] <= 2 * members


def test_members_are_not_met_anew_in_every_group_of_theirs(spark, monkeypatch):
    """Near copies too unlike each other for most links: texts are not compared with heads of all the groups that they are in. Without lists of the pairs that may be alike, classes are the same."""
    against, write_out = [], near_dedup.written

    def counted(df, name):
        out = write_out(df, name)
        if name == "near-against":
            against.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    docs = {k: edited(prose(24, 200), 2 + k % 3, 1300 + k) for k in range(300)}
    want = brute_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    assert got == want and sum(against) <= 2 * len(docs)
    monkeypatch.setattr(near_dedup, "LISTED", 0)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(documents(spark, list(docs.items()))).collect()}
    assert got == want


def test_pairs_that_may_be_alike(spark):
    """Few pairs are listed; of a group with more, the members that may be alike to some other stay."""
    rows = [(1, bytes([k]), bytes([k // 2]), 0.0, 1.0, 1.0 if k < 4 else 0.5, 12) for k in range(12)]  # (0, 1) and (2, 3) are of one class
    rows += [(2, bytes([k]), bytes([k]), 0.0, 1.0, 0.5 if k == 7 else 1.0, 12) for k in range(12)]
    got = near_dedup._may_pairs(spark.createDataFrame(rows, "g long, b binary, class binary, total double, u double, left double, n long")).collect()
    of = {g: sorted((r["b"][0], r["y"] and r["y"][0]) for r in got if r["g"] == g) for g in (1, 2)}
    assert of == {1: [(2, 0), (2, 1), (3, 0), (3, 1)], 2: [(k, None) for k in range(12) if k != 7]}


def test_components(spark):
    rng = random.Random(1)
    links = [(a, a + 1) for a in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    got = {r["id"]: r["class"] for r in near_dedup.components(spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")).collect()}
    up = {x: x for p in links for x in p}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if any(k in p and p[0] != p[1] for p in links)}


def test_sampling_estimates_similarity():
    import numpy as np
    import pyarrow as pa

    idf = np.ones((2, near_dedup.WIDTH), np.float32)
    a, b = prose(1, 4000), edited(prose(1, 4000), 120, 3)
    seen = [near_dedup.sample(pa.array([f"{p} " + a, f"{p} " + b]), idf) for p in range(25)]
    true = near_dedup.similarity(pa.array([a]), pa.array([b]), idf)[0]
    assert abs(np.mean([x[0] == x[1] for x in seen]) - true) < 0.08


def test_exact_native_and_near_keep(spark):
    docs = documents(spark, EDGE)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect())[6] == 0  # equal to 5, up to white space
    near = near_dedup.keep_one(docs)
    assert near.columns == docs.columns and near.count() > 0
    for op in (exact_dedup.keep_first, near_dedup.keep_one, quality.keep_good):
        assert op(documents(spark, [])).count() == 0


def test_keep_first_brute(spark):
    """Rows that stay, by id and text, against a plain rule; with null ids, ids at several rows, long white space and clashing names."""
    import re

    rng = random.Random(3)
    texts = ["", " ", "a b", "a  b", "ab", "a\nb", " " * 5000 + "a b", " " * 5001 + "a b", "x" * 127 + " y", "x" * 127 + "  y", "x" * 127 + " z", *[prose(k, 40) for k in range(4)], prose(1, 40).replace(" ", "\t ")]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *texts])) for _ in range(300)]
    rows += [(1000 + k, f"single {k}") for k in range(20)]
    best: dict[str, tuple] = {}
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best[n] = min(best.get(n, (True, 0)), (d is None, d or 0)) if n in best else (d is None, d or 0)
    got = exact_dedup.keep_first(documents(spark, rows)).collect()
    assert len(got) == len(best)
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""): (r["doc_id"] is None, r["doc_id"] or 0) for r in got} == best
    full = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert len(full) == len(rows) and sum(r["kept"] for r in full) == len(best)
    assert all(r["digest"] is None and r["group_size"] == 1 for r in full if (r["doc_id"] or 0) >= 1010)


def mix_table() -> tuple[list, list]:
    docs, labels = [], []
    for d in range(400):
        toxic, poor = d % 10 == 0, d % 10 in (1, 2)
        text = prose(d, 80) + (" vile idiot scum disgusting loser moron trash" * 2 if toxic else " buy click now cheap offer deal" * 3 if poor else " the study of the river")
        docs.append((d, text))
        if d % 2 == 0 or d % 10 == 1:
            labels.append((d, int(not poor and not toxic), int(toxic)))
    return docs, labels


def test_mixing_meets_targets(spark, tmp_path):
    folder = write(spark, tmp_path / "mix", *mix_table())
    got = queries.op2_mixing(spark, folder).collect()
    assert len(got) == 400 and all(r["rate"] >= 0 and abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 for r in got)
    total = sum(r["n_tokens"] for r in got)
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / total - share) < 0.01
    right = [max("good poor toxic".split(), key=lambda d: r[f"p_{d}"]) == ("toxic" if r["doc_id"] % 10 == 0 else "poor" if r["doc_id"] % 10 in (1, 2) else "good") for r in got]
    assert sum(right) > 380
    assert abs(sum(r["copies"] for r in got) - sum(r["rate"] for r in got)) < 0.2 * len(got)


def test_mixing_rates_solve_the_least_squares(spark):
    """Projected gradient against a plain numpy version of the same steps, with and without a ceiling; and its end against the conditions of a minimum."""
    import numpy as np

    rng = np.random.default_rng(5)
    p, n, m = rng.dirichlet([0.3, 0.3, 0.3], 300), rng.integers(0, 500, 300), rng.integers(1, 4, 300)
    table = spark.createDataFrame([(k, k, int(n[k]), int(m[k]), *map(float, p[k])) for k in range(300)], "id long, h long, n_tokens long, m long, p0 double, p1 double, p2 double")
    for targets, ceiling in (({"good": 0.6, "poor": 0.3, "toxic": 0.1}, None), ({"good": 0.9, "poor": 0.1, "toxic": 0.0}, 1.0)):
        rate, info = mixing.rates(table, targets, max_rate=ceiling)
        x = np.array([r[0] for r in table.select(rate, "id").orderBy("id").collect()])
        mass = (n * m)[:, None] * p
        have, gram = mass.sum(0), mass.T @ p
        goal = np.array([targets[d] for d in mixing.DOMAINS]) * have.sum()
        metric = np.linalg.pinv(gram + np.eye(3) * np.trace(gram) * 1e-9)
        want, best = np.ones(300), math.inf
        for _ in range(mixing.ROUNDS):
            miss = mass.T @ want - goal
            size = miss @ metric @ miss
            if np.abs(miss).max() <= mixing.TOLERANCE * have.sum() or size > best * (1 - 1e-4):
                break
            best = size
            want = np.clip(want - np.where(n > 0, p @ (metric @ miss), 0.0), 0.0, ceiling or math.inf)
        assert np.allclose(x, want, rtol=1e-6, atol=1e-9) and (x >= 0).all()
        if not ceiling:
            assert np.allclose(mass.T @ x, info["target"], rtol=1e-3)


def test_mixing_fit():
    """The classifier's end has no slope left, and knows what decides."""
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 600)
    rows = [np.unique(np.r_[rng.integers(0, 30, 6), [30 + k] * (rng.random() < 0.8)]).astype(int) for k in y]
    w, bias = mixing.fit(rows, y, 33, 3)
    score = np.array([bias + w[r].sum(0) for r in rows])
    assert np.mean(score.argmax(1) == y) > 0.8 and all(w[30 + k].argmax() == k for k in range(3))
    e = np.exp(score - score.max(1, keepdims=True))
    assert np.abs((e / e.sum(1, keepdims=True)).mean(0) - np.bincount(y) / 600).max() < 0.01
    assert mixing.fit([], np.zeros(0, int), 2, 3)[0].shape == (2, 3)


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (13, 0, 0), (None, 1, 1), (15, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixing(documents(spark, EDGE), labels).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(d) for d, _ in EDGE)
    assert all(r["n_tokens"] == 0 and r["rate"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["n_tokens"] for r in got if r["doc_id"] == 6} == {4}
    assert mixing.mixing(documents(spark, []), labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert mixing.mixing(documents(spark, EDGE), none).count() == len(EDGE)
    thinned = mixing.thin(documents(spark, EDGE), labels)
    assert thinned.columns == documents(spark, EDGE).columns


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("a < b &amp; c &#233;", "a < b & c é"),
        (page("<nav>menu</nav><article><h1>T</h1><p>one\n two<p>three <b>bo</b>ld<br>next</article><footer>f</footer>"), "T one two three bold next"),
        (page("<div class='ad'>buy</div><p>text</p><form>x<input></form><aside>y</aside>"), "text"),
        (page("<header>h</header><main><header>inner</header>body</main>"), "body"),
        (page("<script>var a='</p><p>no'</script><p>yes</p><!-- <p>hidden</p> --><noscript>n</noscript>"), "yes"),
        (page("<article>real<div class='comments'>no</div> end</article>"), "real end"),
        (page("<p>unclosed <div>next"), "unclosed next"), ("<p title='a>b'>x</p><p", "x"),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html_extract.read(html)) == want


def test_style_tree(spark):
    """What all pages of a host share goes; what differs stays, also without an article element; another host is not touched."""
    rows = [(k, f"http://h.org/{k}", page(f"<div><span>Welcome to our place</span></div><div class=x><p>story {k} {prose(k, 12)}</p></div>")) for k in range(8)]
    rows += [(8, "http://other.org/", rows[0][2]), (9, None, None), (9, None, ""), (10, "http://h.org/x", "<p>" + "word " * 20_000)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, path long")).collect()}
    assert all(got[k]["text"] == f"story {k} {prose(k, 12)}" for k in range(8))
    assert got[8]["text"].startswith("Welcome to our place story 0")
    assert (got[9]["text"], got[9]["n_chars"]) == ("", 0) and got[10]["n_chars"] == 5 * 20_000 - 1
    tree = {r["path"]: r for r in html_extract.style_tree(spark.createDataFrame(rows[:8], "page_id long, url string, html string")).collect()}
    assert {round(r["importance"], 3) for r in tree.values()} == {0.0, 1.0}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_in_articles(spark):
    """What articles of a host share goes from inside them, by path and by place; what varies outside stays; copies and near copies of an article stay whole."""
    end = "<div class=x1>Pass it on to friends</div><p>Printed in our own house</p>"
    bodies = [f"<div class=x0>Hello reader</div><div class=x2>lead {k} of the day</div><{tag}><p>story {k} {prose(k, 20 + k)}</p>{end}</{tag}>" for tag in ("article", "main") for k in range(8)]
    rows = [(k, f"http://{'am'[k // 8]}.org/{k}", page(b)) for k, b in enumerate(bodies)]
    copy = f"<article><p>{prose(99, 40)}</p><blockquote>quoted words</blockquote></article>"
    rows += [(20 + k, f"http://copies.org/{k}", page(copy)) for k in range(6)]
    rows += [(30 + k, f"http://mixed.org/{k}", page(copy if k % 2 else f"<article><p>other {k} {prose(k, 30)}</p></article>")) for k in range(12)]
    rows += [(50 + k, f"http://near.org/{k}", page(f"<article><p>{prose(98, 40)}</p><div class=t>at {k} sharp</div></article>")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"lead {k % 8} of the day story {k % 8} {prose(k % 8, 20 + k % 8)}" for k in range(16))
    assert all(got[20 + k] == prose(99, 40) + " quoted words" for k in range(6))
    assert all(got[30 + k] == (prose(99, 40) + " quoted words" if k % 2 else f"other {k} {prose(k, 30)}") for k in range(12))
    assert all(got[50 + k] == prose(98, 40) + f" at {k} sharp" for k in range(6))


def test_pipeline(spark, tmp_path):
    docs, labels = mix_table()
    extra = [(1000, docs[3][1]), (1001, docs[3][1].replace(" ", "\n")), (1002, edited(docs[4][1], 1, 1)), (1003, "too short"), (1004, " ".join(["same words over and over again and"] * 30)), (1005, None)]
    folder = write(spark, tmp_path / "p", docs + extra, labels)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    text = dict(docs)
    good = {d for d, t in docs if quality_kept(t)}
    clean = {d for d in good if d % 10}
    assert not {*range(1000, 1006)} & set(got)
    assert clean <= set(got) and len(set(got) - clean) <= 2  # toxic ones go
    assert all(r["decoded_sha256"] == hashlib.sha256(text[d].encode()).hexdigest() for d, r in got.items())


def quality_kept(t: str) -> bool:
    import pyarrow as pa

    return bool(quality.judge(pa.array([t]))["kept"][0])


def test_pipeline_edges(spark, tmp_path):
    folder = write(spark, tmp_path / "e", EDGE, [(13, 1, 0)])
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    assert got == [13]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", [])).count() == 0


def test_quality_of_repeats():
    import pyarrow as pa

    long = prose(3, 60)
    out = quality.judge(pa.array([prose(1, 400), long + " " + prose(2, 60) + " " + long, " ".join(f"u{k}" for k in range(500))]))
    assert out["kept"].tolist() == [True, False, True]
    assert out["longest_repeat"].tolist()[1] == 60 and out["covered_words"].tolist()[1] == 120


def test_quality_beyond_the_base_rule():
    """Long repeats decide where the base rule does not: by their share, or by the length of one."""
    import pyarrow as pa

    def twice(passage: int, rest: int) -> str:
        return " ".join([prose(5, rest), prose(6, passage), prose(7, rest), prose(6, passage), prose(8, rest)])

    out = quality.judge(pa.array([twice(40, 170), twice(60, 650), twice(40, 650)]))
    assert out["base_failed"].tolist() == [False, False, False]
    assert out["longest_repeat"].tolist() == [40, 60, 40] and out["covered_words"].tolist() == [80, 120, 80]
    assert out["kept"].tolist() == [False, False, True]


def test_oracles_have_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
