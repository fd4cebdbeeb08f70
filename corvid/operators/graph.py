"""Import and call graphs: resolution, reachability, centrality, callers and callees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import batches as B
from corvid.functions import text as T
from corvid.operators import outline

CALL = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("
NO_CALLS = frozenset("""if for while switch return catch sizeof typeof function fn def class struct enum match loop elif else try except with
assert print defer errdefer comptime test and or not in is lambda yield await async new delete throw case do goto using namespace
template typename static_assert alignof decltype super self import from""".split())
UBIQUITOUS = ("init", "deinit", "get", "set", "add", "new", "push", "pop", "len", "append", "main", "run", "close", "open", "read", "write", "next", "format", "print", "map", "filter", "toString")


def imports(syms: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (src, dst): imports that resolve to a file of the corpus, by the first candidate that exists."""
    lang, spec = T.language(F.col("path")), F.col("name")
    each = syms.where("kind = 'import' and path is not null and name is not null").select(F.col("path").alias("src"), lang.alias("lang"), T.dirname(F.col("path")).alias("folder"), spec.alias("spec"))
    each = each.repartition("lang", "folder", "spec")
    j = each.join(resolved(each, files).hint("shuffle_hash"), ["lang", "folder", "spec"])
    return j.select("src", "dst").where("src != dst").distinct()


def resolved(each: DataFrame, files: DataFrame) -> DataFrame:
    """lang, folder, spec, dst: what an import resolves to depends on its text, the folder and the language only, so that each is tried once, however many files have it."""
    # src is looked at to keep it: with all columns in use, this and the join read the same exchange, and files are taken apart once.
    asked = each.groupBy("lang", "folder", "spec").agg(F.max(F.length("src")).alias("longest")).where("longest >= 0")
    tried = asked.select("lang", "folder", "spec", F.posexplode(_tried(F.col("lang"), F.col("folder"), F.col("spec"))).alias("rank", "dst"))
    found = tried.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    return found.groupBy("lang", "folder", "spec").agg(F.min_by("dst", "rank").alias("dst"))


def _tried(lang: Column, folder: Column, spec: Column) -> Column:
    """Paths that an import may mean in a file of the folder, best first."""
    near = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    rel = F.regexp_replace(F.concat(near, spec), r"(^|/)\./", "$1")
    for _ in range(4):  # one parent step each
        rel = F.regexp_replace(rel, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    dotted = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    py = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(near, dotted, F.lit(".py")), F.concat(near, dotted, F.lit("/__init__.py")))
    ts = F.array(rel, *[F.concat(rel, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")])
    body = F.regexp_replace(F.regexp_replace(spec, r"\s+as\s+\w+|::\*|::?\{.*", ""), r"^(?:crate|self)::", "")
    root = F.regexp_extract(near, r"^(.*?src/)", 1)
    rs_path, parent = F.replace(body, F.lit("::"), F.lit("/")), F.replace(F.regexp_replace(body, r"::[^:]+$", ""), F.lit("::"), F.lit("/"))
    rs = F.array(*[F.concat(at, p, F.lit(e)) for at in (near, root) for p in (rs_path, parent) for e in (".rs", "/mod.rs")])
    return F.concat(F.array(spec), F.when(lang == "python", py).when(lang.isin("typescript", "javascript", "svelte", "vue", "astro"), ts).when(lang == "rust", rs).otherwise(F.array(rel)))


def _step(frontier: DataFrame, edges: DataFrame, alias: bool) -> DataFrame:
    """Files that import one of the frontier, by path or by file name alone."""
    keys = frontier.select(F.col("path").alias("key"))
    if alias:
        keys = keys.unionByName(frontier.select(T.basename(F.col("path")).alias("key"))).distinct()
    return edges.join(keys.hint("shuffle_hash"), F.col("dst") == F.col("key"), "left_semi").select(F.col("src").alias("path")).distinct()


def dependents(edges: DataFrame, path: str, max_depth: int | None = None, alias: bool = True) -> DataFrame:
    """(path, depth) of what imports a file, and what imports that, breadth first. Each level is cut off by checkpoint()."""
    return _reach(edges, path, max_depth, alias)


def dependencies(edges: DataFrame, path: str, max_depth: int | None = None) -> DataFrame:
    """(path, depth) of what a file imports, and so on."""
    turned = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return _reach(turned, path, max_depth, False)


def _reach(edges: DataFrame, path: str, max_depth: int | None, alias: bool) -> DataFrame:
    """Edges are dealt out by what they lead to once and kept so; each level then exchanges files only, and sorts no edge."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dst").persist()
    cut = bool(spark.sparkContext.getCheckpointDir())
    seen = spark.range(1).select(F.lit(path).alias("path"), F.lit(0).alias("depth"))
    level, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = _step(level, edges, alias).join(seen, "path", "left_anti").withColumn("depth", F.lit(depth))
        level = level.checkpoint() if cut else level.persist()
        if level.limit(1).count() == 0:
            break
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def bodies(files: DataFrame) -> DataFrame:
    """Callees of each function: path, ord, name, callee (each once). A file is read as a whole, so that nothing is joined or exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from B.out(((path, *x) for path, lang, t in B.each(batches) for x in called(lang, t or "")), _BODIES)

    return outline.texts(files).mapInArrow(run, "path string, ord int, name string, callee string")


_CALL = re.compile(CALL)
_BODIES = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("callee", pa.string())])


def called(lang: str, content: str) -> Iterator[tuple[int, str, str]]:
    """(ord, name, callee) of a file's functions; a line is taken apart once, however many functions are around it."""
    lines, calls = content.split("\n"), {}
    for k, (name, kind, first, last, _) in enumerate(outline.outline(lang, content)):
        if kind in ("function", "method", "test_decl"):
            seen: dict[str, None] = {}
            for i in range(first, last):
                if i not in calls:
                    calls[i] = dict.fromkeys(c for c in _CALL.findall(lines[i]) if c not in NO_CALLS)
                seen |= calls[i]
            yield from ((k, name, c) for c in seen)


def call_edges(syms: DataFrame, files: DataFrame) -> DataFrame:
    """caller, callee, path of each, and weight: 1 over the number of definitions that the callee's name has.

    Definitions, which are fewer than calls, are the side that is held by key; calls are not sorted.
    """
    d = syms.where(F.col("kind").isin("function", "method")).select(F.col("name").alias("callee"), F.col("path").alias("to_path"))
    d = d.withColumn("n", F.count("*").over(W.partitionBy("callee")))
    j = bodies(files).join(d.hint("shuffle_hash"), "callee")
    return j.select(F.col("name").alias("caller"), "callee", F.col("path").alias("from_path"), "to_path", (1 / F.col("n")).alias("weight"))


def centrality(calls: DataFrame) -> DataFrame:
    """path, centrality: weights of all calls into a file."""
    return calls.groupBy(F.col("to_path").alias("path")).agg(F.sum("weight").alias("centrality"))


def callees(calls: DataFrame, name: str) -> DataFrame:
    """What a function calls, as far as its name is defined once, is none that every library has, and is no test."""
    return calls.where((F.col("caller") == name) & (F.col("weight") == 1) & ~F.col("callee").isin(*UBIQUITOUS) & (F.col("callee") != name) & ~T.is_test(F.col("to_path")))


def call_status(name: str):  # noqa: ANN201
    """What a line that holds the name's letters is: call, or why it is none."""
    line, q = F.col("line"), T.whole_word(name)
    before = F.regexp_extract("line", rf"^(.*?){q}", 1)
    code = F.regexp_replace(before, r"\"[^\"]*\"|'[^']*'", "")
    quotes = (F.length(code) - F.length(F.replace(code, F.lit('"'), F.lit("")))) % 2 == 1
    return (
        F.when(T.language(F.col("path")).isin("markdown", "json", "yaml", "css", "scss", "protobuf", "unknown"), "no_calls")
        .when(~line.rlike(q), F.when(line.contains(name), "substring").otherwise("case_variant"))
        .when(code.contains("#") | code.contains("//") | code.contains("--") | quotes, "comment_or_string")
        .when(line.rlike(r"^\s*(?:from|import|use|#include)\b"), "import")
        .when(line.rlike(rf"\b(?:def|fn|func|fun|function|class|struct|enum|interface|trait|type|const|let|var|val)\s+{q}"), "definition")
        .when(line.rlike(rf"{q}\s*[,)>;]") | code.rlike(r"(?::|<|->)[^=;{}]*$"), "type_position")
        .when(line.rlike(rf"{q}[ \t]*\("), "call")
        .otherwise("reference")
    )


def callers(lines: DataFrame, syms: DataFrame, name: str) -> DataFrame:
    """path, line_num, line, status of all lines that hold the name, whatever its case."""
    d = syms.where((F.col("name") == name) & (F.col("kind") != "import")).select("path", F.col("line_start").alias("line_num"), F.lit(True).alias("defined"))
    hits = lines.where(T.fold(F.col("line")).contains(name.lower())).join(d, ["path", "line_num"], "left")
    return hits.select("path", "line_num", "line", F.when(F.col("defined"), "definition").otherwise(call_status(name)).alias("status"))


def blast_radius(edges: DataFrame, path: str, max_depth: int = 3) -> DataFrame:
    """depth, files: how many files depend on one, by distance."""
    return dependents(edges, path, max_depth).groupBy("depth").agg(F.count("*").alias("files"))


def ambiguous(syms: DataFrame) -> DataFrame:
    """Names with several definitions, and how many."""
    w = W.partitionBy("name")
    return syms.where(F.col("kind") != "import").withColumn("n", F.count("*").over(w)).where("n > 1").select("name", "n").distinct()
