"""Operators on small inline sources, against known results and plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import edit, graph, index, outline, search, versions
from corvid.sources import corpus

FILES = [
    ("src/app.py", "import util\nfrom lib.core import Thing\n\ndef run(x):\n    # helper(1)\n    return helper(x)\n\nclass App:\n    pass\n"),
    ("util.py", "def helper(x):\n    return parseHTTPResponse(x)\n"),
    ("lib/core.py", "class Thing:\n    def go(self):\n        return 1\n"),
    ("docs/guide.md", "helper is described here\nHelper HELPER\n"),
    ("test/test_util.py", "import util\n\ndef test_helper():\n    helper(2)\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


@pytest.fixture(scope="module")
def lines(files):
    return corpus.lines(files)


def paths(df):
    return sorted(r["path"] for r in df.select("path").distinct().collect())


def test_lines(lines):
    got = {(r["path"], r["line_num"]): r["line"] for r in lines.collect()}
    assert got == {(p, k): x for p, c in FILES for k, x in enumerate(c.split("\n"), 1)}


@pytest.mark.parametrize(
    ("word", "want"),
    [("parseHTTPResponse", ["parse", "http", "response"]), ("snake_case_name", ["snake", "case", "name"]), ("abc", []), ("lower", []), ("getX2Value", ["get", "value"]), ("ABCd", ["ab", "cd"])],
)
def test_subtokens(spark, word, want):
    assert spark.range(1).select(T.subtokens(F.lit(word))).first()[0] == want


def test_postings(lines):
    got = {(r["word"], r["path"]) for r in index.word_postings(lines).collect()}
    assert {("helper", "util.py"), ("http", "util.py"), ("parsehttpresponse", "util.py"), ("helper", "docs/guide.md")} <= got
    assert paths(index.word_lookup(index.word_postings(lines), "HELPER")) == ["docs/guide.md", "src/app.py", "test/test_util.py", "util.py"]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("*.md", ["docs/guide.md"]), ("src/*.py", ["src/app.py"]), ("**/*.py", ["lib/core.py", "src/app.py", "test/test_util.py", "util.py"]), ("{src,lib}/*", ["lib/core.py", "src/app.py"]), ("[!l]*/?pp.py", ["src/app.py"]), ("*", [p for p, _ in sorted(FILES)])],
)
def test_glob(files, pattern, want):
    assert paths(search.glob(files, pattern)) == want


def test_glob_refuses_nested_braces():
    with pytest.raises(ValueError):
        T.glob_regex("{a,{b,c}}")


@pytest.mark.parametrize("bad", ["", r"(?=x)", r"\q", "(", r"(?P<n>x)"])
def test_regex_dialect(bad):
    with pytest.raises((ValueError, re.error)):
        T.checked_regex(bad)


@pytest.mark.parametrize(("pattern", "runs"), [("abcdef", ["abcdef"]), ("abc|def", None), ("(abc)?def", ["def"]), ("abcd?ef", ["abc"]), (r"foo\.bar", ["foo.bar"]), (r"\d{10}x", None), ("a[bc]d", None)])
def test_prefilter_is_sound(pattern, runs):
    assert T.literal_runs(pattern) == runs


def test_literal_and_candidates(files, lines):
    assert paths(search.literal(lines, "HELPER(")) == ["src/app.py", "test/test_util.py", "util.py"]
    grams = index.trigrams(files)
    assert set(paths(index.trigram_candidates(grams, "helper("))) >= set(paths(search.literal(lines, "helper(")))
    assert index.trigram_candidates(grams, "he") is None


def test_bm25_prefers_code(lines):
    top = search.ranked(lines, "parse response").collect()
    assert [r["path"] for r in top] == ["util.py"] and top[0]["line_num"] == 2


def test_outline(files):
    got = {(r["path"], r["name"], r["kind"], r["line_start"], r["line_end"]) for r in outline.symbols(files).collect()}
    assert {("src/app.py", "run", "function", 4, 6), ("src/app.py", "App", "class_def", 8, 9), ("util.py", "helper", "function", 1, 2), ("src/app.py", "lib.core", "import", 2, 2)} <= got


def test_graph(files, lines):
    syms = outline.symbols(files)
    edges = graph.imports(syms, files)
    assert {tuple(r) for r in edges.select("src", "dst").collect()} == {("src/app.py", "util.py"), ("src/app.py", "lib/core.py"), ("test/test_util.py", "util.py")}
    assert paths(graph.dependents(edges, "util.py")) == ["src/app.py", "test/test_util.py"]
    assert paths(graph.dependencies(edges, "src/app.py")) == ["lib/core.py", "util.py"]
    calls = {(r["path"], r["line_num"], r["status"]) for r in graph.callers(lines, syms, "helper").collect()}
    assert {("src/app.py", 5, "comment_or_string"), ("src/app.py", 6, "call"), ("util.py", 1, "definition"), ("docs/guide.md", 1, "no_calls"), ("test/test_util.py", 4, "call")} <= calls


def test_imports_are_resolved_once_for_a_folder(spark):
    """What many files of a folder import is tried once, from rows that are read once; the results are those of each file."""
    many = [(f"app/f{k}.py", "import lib.core\nimport lib.core\nfrom helper import x\n") for k in range(50)]
    other = [("lib/core.py", "import lib.core\n"), ("app/helper.py", ""), ("web/src/a/m.rs", "use crate::b::Thing;\nmod n;\n"), ("web/src/b.rs", ""), ("web/src/a/n.rs", ""), ("web/x.ts", "import y from './y'\n"), ("web/y.ts", ""), ("top.py", "import lib.core\n")]
    files = spark.createDataFrame(many + other, "path string, content string")
    edges = graph.imports(outline.symbols(files), files)
    want = {(p, d) for p, _ in many for d in ("lib/core.py", "app/helper.py")}
    want |= {("web/src/a/m.rs", "web/src/b.rs"), ("web/src/a/m.rs", "web/src/a/n.rs"), ("web/x.ts", "web/y.ts"), ("top.py", "lib/core.py")}
    assert sorted(map(tuple, edges.collect())) == sorted(want)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final
    each = spark.createDataFrame([(f"app/f{k}.py", "python", "app", "lib.core") for k in range(50)], "src string, lang string, folder string, spec string")
    assert [tuple(r) for r in graph.resolved(each, files).collect()] == [("python", "app", "lib.core", "lib/core.py")]


def test_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r["path"], r["depth"]) for r in graph.dependents(edges, "a").collect()} == {("c", 1), ("b", 2)}


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "created"), ("b", 2, "created"), ("a", 3, "modified"), ("a", 5, "deleted")], "path string, seq long, op string").withColumn("size", F.lit(1.0)).withColumn("timestamp", F.col("seq"))
    ops = lambda df: {r["path"]: (r["seq"], r["op"]) for r in df.collect()}
    assert ops(versions.latest(log)) == {"a": (5, "deleted"), "b": (2, "created")}
    assert ops(versions.as_of(log, 4)) == {"a": (3, "modified"), "b": (2, "created")}
    assert ops(versions.changes_since(log, 2)) == {"a": (5, "deleted")}
    assert versions.history(log, 2).count() == 3


def test_edits(spark, files):
    ln = spark.createDataFrame([("f", k, x) for k, x in enumerate("abcd", 1)], "path string, line_num int, line string")
    edits = spark.createDataFrame([("f", "replace", 2, 3, "X\nY\nZ"), ("f", "insert", 4, 4, "end"), ("f", "delete", 1, 1, None)], "path string, op string, first int, last int, text string")
    assert [r["line"] for r in edit.apply_edits(ln, edits).orderBy("line_num").collect()] == ["X", "Y", "Z", "d", "end"]
    once = {r["path"]: r["ok"] for r in edit.replace_once(files, "src/app.py", "return", "yield").collect()}
    assert once["src/app.py"] is True
    assert not {r["path"]: r["ok"] for r in edit.replace_once(files, "docs/guide.md", "e", "x").collect()}["docs/guide.md"]


@pytest.mark.parametrize(("code", "lang", "bad"), [("f(a[1])", "python", None), ("f(a[1)", "python", "line 1"), ("x = ')' # (", "python", None), ("/* ( */ f({})", "c", None), ("a\nb {", "c", "line 2")])
def test_health(code, lang, bad):
    got = edit.health(code, lang)
    assert got is None if bad is None else got.startswith(bad)


def test_dropped_import():
    assert edit.dropped_import("import os\nos.getcwd()", "os.getcwd()") == "os"
    assert edit.dropped_import("import os\nos.getcwd()", "import os\nos.getcwd()") is None


def test_sparse_spans_cover():
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    spans = index.sparse_spans(text, {(a, b): (ord(a) * 7 + ord(b) * 13) % 100 for a in text for b in text})
    assert all(3 <= b - a <= 16 for a, b in spans) and {k for a, b in spans for k in range(a, b)} == set(range(len(text)))


def test_sparse_ngrams_beyond_65536_pairs(spark):
    """Rare pairs keep their weights however many frequent ones there are."""
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    weight = {(a, b): (ord(a) * 7 + ord(b) * 13) % 100 for a in text for b in text}
    filler = spark.range(1 << 16).selectExpr("concat('x', id) AS a", "'y' AS b", "9L AS n", "1 AS weight")
    pairs = filler.unionByName(spark.createDataFrame([(a, b, 1, w) for (a, b), w in weight.items()], "a string, b string, n long, weight int"))
    got = index.sparse_ngrams(spark.createDataFrame([("p", text.upper()), ("q", "ab"), ("r", "")], "path string, content string"), pairs)
    assert {tuple(r) for r in got.collect()} == {(text[a:b], "p") for a, b in index.sparse_spans(text, weight)}


def test_sparse_ngrams_hold_no_table_in_memory(spark):
    """Rows leave Python in bounded batches as they are made, and texts are not exchanged where all pairs are in the dictionary."""
    import pyarrow as pa

    from corvid.functions import batches

    taken = []
    rows = ((taken.append(k) or "gram", "path") for k in range(5 * batches.ROWS + 7))
    got = batches.out(rows, pa.schema([("gram", pa.string()), ("path", pa.string())]))
    assert next(got).num_rows == len(taken) == batches.ROWS
    assert [b.num_rows for b in got] == [batches.ROWS] * 4 + [7]
    few = spark.createDataFrame([("t", "h", 3, 9), ("h", "e", 2, 11)], "a string, b string, n long, weight int")
    df = index.sparse_ngrams(spark.createDataFrame([("p", "The then"), ("q", None)], "path string, content string"), few)
    assert "Join" not in df._jdf.queryExecution().toString() and {tuple(r) for r in df.collect()} == {("the then", "p")}


def test_batch_takes_all_words(spark, tmp_path):
    """Short words and parts of compound words decide as long ones do; scores against plain Python."""
    import math
    from collections import Counter

    from corvid.plans import registry

    docs = {0: "plain words standing everywhere\nox", 1: "plain words standing everywhere", 2: "getHttpThing plain", 3: "http thing", 4: "words a b c", 5: ""}
    asked = {7: "ox words", 8: "HttpServer a", 9: "parseThing everywhere", 10: "x"}
    spark.createDataFrame([(k, t, "en", "src0") for k, t in docs.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], int(re.search(r"doc_(\d+)", r["path"])[1])): r["score"] for r in registry.bm25_batch_whole(spark, str(tmp_path)).collect()}
    tf = {d: Counter(w for line in t.split("\n") for w in search.terms_of(line)) for d, t in docs.items()}
    size = {d: len([w for w in re.findall(r"\w+", t) if len(w) >= 2]) for d, t in docs.items()}
    df, avg, want = Counter(w for c in tf.values() for w in c), sum(size.values()) / len(docs), {}
    for q, t in asked.items():
        for d, c in tf.items():
            part = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * max(size[d], 1) / avg)) + 0.5) for w in search.terms_of(t) if c[w]]
            if part:
                want[q, d] = sum(part)
    assert got == pytest.approx(want, abs=2e-6) and {d for q, d in got if q == 8} == {2, 3}
    assert got[7, 0] > 2 * got[7, 1]


def test_files_in_reads_what_is_text(spark, tmp_path):
    """Binary and wrongly encoded files abort nothing; skipped folders, secrets, large and ignored files are left out."""
    files = {
        "a.py": b"x = 1\n", "bad.txt": b"caf\xe9 \xff ok\n", "nul.dat": b"ab\0cd", "late.txt": b"y" * 600 + b"\0", "img.PNG": b"png", "node_modules/m.js": b"m", "Out/kept.py": b"k",
        "out/o.py": b"o", "conf/.envrc": b"s", "conf/Service-Account.json": b"s", "conf/prod.env": b"s", "big.txt": b"z" * 3000, "logs/x.log": b"l", "logs/keep.log": b"k", "empty.txt": b"",
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r["path"]: r["content"] for r in corpus.files_in(spark, f"file:{tmp_path}", ["*.log", "!keep.log"], 2000).collect()}
    assert set(got) == {"a.py", "bad.txt", "late.txt", "Out/kept.py", "logs/keep.log"}
    assert got["bad.txt"] == "caf� � ok\n" and got["a.py"] == "x = 1\n"


def test_nul_in_patterns(spark):
    one = spark.createDataFrame([("a\0b",), ("a0b",), ("a\\0b",)], "c string")
    assert [r[0] for r in one.where(F.col("c").rlike(T.checked_regex(r"a\0b"))).collect()] == ["a\0b"]
    assert [r[0] for r in one.where(F.col("c").rlike(T.checked_regex(r"a\\0b"))).collect()] == ["a\\0b"]


def test_append_numbers_ties_once(spark):
    """Numbers go on without gaps, and ties in time and path go by the other columns."""
    schema = "path string, op string, size long, timestamp long"
    log = spark.createDataFrame([("p", 1, "created", 1, 0)], "path string, seq long, op string, size long, timestamp long")
    fresh = [("p", "modified", k % 7, k // 20) for k in range(200)] + [("q", "created", 0, 3)] * 3
    got = versions.append(log, spark.createDataFrame(fresh, schema).repartition(7)).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 205))
    assert [(r["timestamp"], r["path"], r["op"], r["size"]) for r in got[1:]] == sorted((t, p, o, s) for p, o, s, t in fresh)


def test_run_steps(spark, files, lines):
    from corvid.plans.pipeline import Corpus, bundle, run_steps

    c = Corpus(files)
    rows, why = run_steps(c, [{"op": "glob", "pattern": "**/*.py"}, {"op": "search", "query": "helper"}, {"op": "limit", "n": 3}], checked=True)
    assert why is None and rows.count() == 3
    for bad in ({"op": "_with", "name": "x", "paths": None}, {"op": "counts"}, {"op": "limit", "n": 0}, {"op": "glob"}, {}):
        rows, why = run_steps(c, [{"op": "glob", "pattern": "src/*"}, bad])
        assert why.startswith("step 2: ") and paths(rows) == ["src/app.py"]
    assert [why for _, why in bundle(c, [[{"op": "glob", "pattern": "*"}], [{"op": "nothing"}]])][0] is None
    with pytest.raises(ValueError, match="twenty"):
        bundle(c, [])


def test_index_parts(spark, files, lines, tmp_path):
    """Stored postings are read again; files taken out and put back; candidates by covering parts; previews; hashes."""
    p = index.word_postings(lines)
    index.save(p, f"{tmp_path}/words", "word")
    stored = spark.read.parquet(f"{tmp_path}/words")
    assert paths(index.word_lookup(stored, "helper")) == paths(index.word_lookup(p, "helper"))
    gone = spark.createDataFrame([("util.py",)], "path string")
    assert "util.py" not in paths(index.without(stored, gone))
    put_back = index.replaced(stored, gone, p.where("path = 'util.py'")).select(*p.columns)
    assert sorted(map(tuple, put_back.collect())) == sorted(map(tuple, p.collect()))
    grams = index.sparse_ngrams(files, index.pair_frequencies(files.select("path", T.fold(F.col("content")).alias("content"))))
    assert {"util.py"} <= set(paths(index.covering_candidates(grams, "def helper(x):\n    return parseHTTPResponse(x)")))
    edits = spark.createDataFrame([("util.py", "replace", 1, 1, "def other(x):")], "path string, op string, first int, last int, text string")
    new = edit.apply_edits(lines, edits)
    assert [(r["path"], r["line_num"], r["old"], r["new"]) for r in edit.preview(lines, new).collect()] == [("util.py", 1, "def helper(x):", "def other(x):")]
    h = {r["path"]: r["hash"] for r in edit.content_hash(lines).collect()}
    assert edit.read_range(lines, "util.py", if_hash=h["util.py"]).count() == 0 and edit.read_range(lines, "util.py", if_hash=1).count() == 3


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abc|defg", [["abc"], ["defg"]]), (r"ab\|c|xyz", [["ab|c"], ["xyz"]]), ("[|]abc", [["abc"]]), ("[]|]abc|def", [["abc"], ["def"]]), ("abc|d", None), ("(a|b)cde", [["cde"]]), ("abc|(d|e)fgh", [["abc"], ["fgh"]]), ("", None)],
)
def test_literal_groups(pattern, want):
    assert T.literal_groups(pattern) == want


def test_trigrams_brute(spark):
    """Grams and both masks against a plain loop, with NUL, white space, short texts and characters outside the first plane."""
    texts = ["", "ab", "abc", "a b  \t\n c", "AbCabcabc", "x\0y\0\0z", "\U0001f600é中\U0001f600é中!", "abab" * 40]
    got = {(r["gram"], r["path"]): (r["next_mask"], r["loc_mask"]) for r in index.trigrams(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")).collect()}
    want: dict = {}
    for k, t in enumerate(texts):
        t = t.lower()
        for i in range(len(t) - 2):
            if t[i : i + 3].strip(" \t\n\x0b\x0c\r"):
                a, b = want.get((t[i : i + 3], str(k)), (0, 0))
                want[t[i : i + 3], str(k)] = a | (1 << ord(t[i + 3]) % 8 if i + 3 < len(t) else 0), b | 1 << i % 8
    assert got == want


def test_symbols_leave_python_as_they_are_found(spark, monkeypatch):
    """Symbols of many files make several batches, and with a name only the files that hold it are taken apart."""
    from corvid.functions import batches

    read = []
    rows = ((p, k, *s) for p in range(40) for k, s in enumerate(read.append(p) or outline.outline("python", "import a\n" * 1000)))
    first = next(batches.out(((str(p), *x) for p, *x in rows), outline._ARROW))
    assert first.num_rows == batches.ROWS and len(read) < 12
    files = spark.createDataFrame([("a.py", "def alpha():\n    pass\n"), ("b.py", "def beta():\n    alpha()\n"), ("c.py", None), ("d.go", "import (\n\t\"alpha\"\n)\n")], "path string, content string")
    named = outline.symbols(files, "alpha")
    assert {(r["path"], r["name"]) for r in named.collect()} == {("a.py", "alpha"), ("b.py", "beta"), ("d.go", "alpha")}
    assert sorted(map(tuple, outline.find_symbol(named, "alpha").collect())) == sorted(map(tuple, outline.find_symbol(outline.symbols(files), "alpha").collect()))


def test_call_edges_join_definitions_only(spark):
    """Bodies are read from files without a join; calls are not sorted to meet the definitions; weights are shared among those of a name."""
    src = {
        "a.py": "def one():\n    two(); two()\n    if (x):\n        three (1)\n\ndef two():\n    def inner():\n        one()\n    inner()\n",
        "b.py": "import a\ndef three():\n    return four()\n",
        "c.py": "def three():\n    pass\n",
        "d.md": "def three():\n    one()\n",
    }
    files = spark.createDataFrame(list(src.items()), "path string, content string")
    plan = graph.bodies(files)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r["path"], r["name"], r["callee"]) for r in graph.bodies(files).collect()} == {("a.py", "one", "two"), ("a.py", "one", "three"), ("a.py", "two", "inner"), ("a.py", "two", "one"), ("a.py", "inner", "one"), ("b.py", "three", "four")}
    calls = graph.call_edges(outline.symbols(files), files)
    assert "SortMergeJoin" not in calls._jdf.queryExecution().executedPlan().toString()
    got = {(r["caller"], r["callee"], r["from_path"], r["to_path"], r["weight"]) for r in calls.collect()}
    assert got == {("one", "two", "a.py", "a.py", 1.0), ("two", "inner", "a.py", "a.py", 1.0), ("two", "one", "a.py", "a.py", 1.0), ("inner", "one", "a.py", "a.py", 1.0), ("one", "three", "a.py", "b.py", 0.5), ("one", "three", "a.py", "c.py", 0.5)}
    assert {r["path"]: r["centrality"] for r in graph.centrality(calls).collect()} == {"a.py": 4.0, "b.py": 0.5, "c.py": 0.5}


def test_bm25_takes_lines_apart_once(spark):
    """Counts of lines in any order and number of parts; best keeps ties; scores are those of the join for any number of queries."""
    docs = [(f"d{k}", n, line) for k in range(12) for n, line in enumerate(["parseThing the_end X", "thing END end", "", None, "HTTPServer2 a bc " * (k % 4)], 1)]
    lines = spark.createDataFrame(docs, "path string, line_num int, line string").repartition(5, "line_num")
    queries = spark.createDataFrame([("a", ["thing", "end", "end"]), ("b", ["server", "http", "2", "zz"]), (None, ["parsething"]), ("c", ["zz", None])], "query_id string, terms array<string>")
    plain = lambda df: sorted((str(r["query_id"]), r["path"], round(r["score"], 9), r["best_line"]) for r in df.collect())
    want = plain(search._scores_by_join(lines.fillna("", "line"), queries))
    assert plain(search.bm25_scores(lines, queries)) == want and len(want) == 12 + 9 + 12
    assert plain(search.bm25_scores(lines.coalesce(1), queries, best=1)) == [r for r in want if r[2] == max(x[2] for x in want if x[0] == r[0])]
    assert search.bm25_scores(lines, queries)._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_candidates_look_for_their_grams_only(spark):
    texts = ["", "ab", "THAND  reed", "thand\nxREED thand", "than d reed", "eed ree and han tha \U0001f600é中", None]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")
    few, every = index.trigrams(files, ["ree", "é中x", "\U0001f600é中"]), index.trigrams(files)
    assert sorted(map(tuple, few.collect())) == sorted(tuple(r) for r in every.collect() if r["gram"] in ("ree", "\U0001f600é中"))
    assert paths(index.candidates_in(files, pattern=r"thand\s+x?reed")) == paths(index.regex_candidates(every, r"thand\s+x?reed")) == ["2", "3", "5"]
    assert paths(index.candidates_in(files, "ThAnd")) == paths(index.trigram_candidates(every, "thand")) == ["2", "3", "5"]
    assert index.candidates_in(files, pattern="a|bcd") is None and index.candidates_in(files, "ab") is None


def test_levels_exchange_files_only(spark):
    """Edges that are dealt out once are neither exchanged nor sorted by a level; names without folders reach as before."""
    edges = spark.createDataFrame([("a.py", "lib/b.py"), ("b", "a.py"), ("c", "b"), ("d", "b.py"), ("a.py", "c")], "src string, dst string")
    dealt = edges.repartition(4, "dst").persist()
    dealt.count()
    level = graph._step(spark.createDataFrame([("lib/b.py",)], "path string"), dealt, False)
    level.collect()
    plan = level._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert "ShuffledHashJoin" in final and "Sort" not in final.replace("SortAggregate", "") and "hashpartitioning(dst" not in final.split("InMemoryRelation")[0]
    assert {tuple(r) for r in graph.dependents(edges, "lib/b.py").collect()} == {("a.py", 1), ("d", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in graph.dependencies(edges, "b").collect()} == {("a.py", 1), ("lib/b.py", 2), ("c", 2)}
    dealt.unpersist()


def test_context_without_a_table_of_symbols(spark, files):
    """Names are looked up in the files that hold them, with the rows that a table of all symbols gives."""
    from corvid.plans.pipeline import Corpus, context

    syms = outline.symbols(files)
    edges = graph.imports(syms, files)
    rows = lambda c: sorted(map(str, context(c, "what breaks if `helper` changes").collect()))
    got = rows(Corpus(files, imports=edges))
    assert got == rows(Corpus(files, syms, edges)) and any("dependent" in r for r in got)
