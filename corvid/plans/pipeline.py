"""Composable steps over a set of files: each step narrows the set or turns it into rows; nothing runs before the end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import graph, outline, search
from corvid.sources import corpus


@dataclass
class Corpus:
    """The tables that steps read; symbols and imports are needed by the steps named like them only."""

    files: DataFrame
    symbols: DataFrame | None = None
    imports: DataFrame | None = None
    _lines: DataFrame | None = field(default=None, repr=False)

    @property
    def lines(self) -> DataFrame:
        if self._lines is None:
            self._lines = corpus.lines(self.files)
        return self._lines

    def named(self, name: str) -> DataFrame:
        """Symbols of a name; without a table of symbols from the files that hold the name."""
        syms = outline.symbols(self.files, name) if self.symbols is None else self.symbols
        return syms.where(F.col("name") == name)


class Pipeline:
    """Pipeline(corpus).glob("src/**").search("x").limit(5).rows()"""

    def __init__(self, c: Corpus, paths: DataFrame | None = None, out: DataFrame | None = None, log: tuple = ()) -> None:
        self.c, self.paths, self.out, self.log = c, paths, out, log
        if len(log) > 10:
            raise ValueError("a pipeline has ten steps at most")

    def _files(self) -> DataFrame:
        return self.c.files if self.paths is None else self.c.files.join(self.paths, "path", "left_semi")

    def _lines(self) -> DataFrame:
        return self.c.lines if self.paths is None else self.c.lines.join(self.paths, "path", "left_semi")

    def _with(self, name: str, paths: DataFrame | None, out: DataFrame | None = None) -> Pipeline:
        return Pipeline(self.c, self.paths if paths is None else paths.select("path").distinct(), out, (*self.log, (name, paths if out is None else out)))

    def find(self, query: str, limit: int = 50) -> Pipeline:
        return self._with("find", search.find_files(self._files(), query, limit))

    def glob(self, pattern: str) -> Pipeline:
        return self._with("glob", search.glob(self._files(), pattern))

    def search(self, query: str, limit: int = 50) -> Pipeline:
        hits = search.reranked(self._lines(), query, limit)
        return self._with("search", hits, hits)

    def word(self, word: str) -> Pipeline:
        hits = search.whole_word(self._lines(), word)
        return self._with("word", hits, hits)

    def filter(self, ext: str | None = None, glob: str | None = None, regex: str | None = None) -> Pipeline:
        f = self._files()
        f = f.where(F.col("path").endswith(ext)) if ext else f
        f = search.glob(f, glob) if glob else f
        f = f.where(F.col("path").rlike(T.checked_regex(regex))) if regex else f
        return self._with("filter", f)

    def deps(self, imported_by: bool = True, transitive: bool = False) -> Pipeline:
        """The set and what imports it (or what it imports), one level or all."""
        if self.c.imports is None or self.paths is None:
            raise ValueError("deps needs imports and a set of files")
        e = self.c.imports if imported_by else self.c.imports.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        e = e.persist() if transitive else e
        level = seen = self.paths
        while True:
            level = e.join(level.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path")).distinct().join(seen, "path", "left_anti").persist()
            if level.limit(1).count() == 0:
                break
            seen = seen.unionByName(level)
            if not transitive:
                break
        return self._with("deps", seen)

    def symbol(self, name: str) -> Pipeline:
        out = self.c.symbols.where(F.col("name") == name)
        out = out if self.paths is None else out.join(self.paths, "path", "left_semi")
        return self._with("symbol", out, out)

    def outline(self) -> Pipeline:
        out = self.c.symbols if self.paths is None else self.c.symbols.join(self.paths, "path", "left_semi")
        return self._with("outline", None, out)

    def read(self, first: int = 1, last: int = 50) -> Pipeline:
        return self._with("read", None, self._lines().where(F.col("line_num").between(first, last)))

    def sort(self) -> Pipeline:
        return self._with("sort", None, self.rows().orderBy("path"))

    def limit(self, n: int = 10) -> Pipeline:
        if not 1 <= n <= 100:
            raise ValueError("limit is from 1 to 100")
        rows = self.rows()
        cols = [c for c in ("score", "path", "line_num", "ord") if c in rows.columns]
        kept = rows.orderBy(*[F.desc(c) if c == "score" else F.col(c) for c in cols]).limit(n)
        return self._with("limit", kept, kept if self.out is not None else None)

    def rows(self) -> DataFrame:
        return self.out if self.out is not None else self.paths if self.paths is not None else self.c.files.select("path")

    def counts(self) -> list[tuple[str, int]]:
        """Rows after each step; each is a job of its own."""
        return [(name, df.count()) for name, df in self.log if df is not None]


#: Steps that a caller may name.
STEPS = frozenset("find glob search word filter deps symbol outline read sort limit".split())


def run_steps(c: Corpus, steps: list[dict], checked: bool = False) -> tuple[DataFrame, str | None]:
    """Steps as dictionaries ({"op": "glob", ...}); at the first that fails, what there was before it, and why.

    A step fails when it is planned: unknown, with wrong arguments, or beyond a limit. With ``checked`` each is also run, a job
    a step, so that one that only fails on the data is told as well and what was there before it is not lost.
    """
    p = Pipeline(c)
    for k, step in enumerate(steps):
        args = {x: v for x, v in step.items() if x != "op"}
        op = step.get("op")
        if op not in STEPS:
            return p.rows(), f"step {k + 1}: no step is named {op!r}"
        try:
            done = getattr(p, op)(**args)
            if checked:
                done.rows().write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            return p.rows(), f"step {k + 1}: {e}"
        p = done
    return p.rows(), None


def bundle(c: Corpus, calls: list[list[dict]]) -> list[tuple[DataFrame, str | None]]:
    """Up to twenty pipelines over one corpus."""
    if not 1 <= len(calls) <= 20:
        raise ValueError("a bundle has one to twenty calls")
    return [run_steps(c, steps) for steps in calls]


def blast(c: Corpus, name: str) -> DataFrame:
    """section, path, n: definitions and callers of a name, and what depends on the files that define it."""
    d = c.named(name).where("kind != 'import'")
    calls = graph.callers(c.lines, c.named(name), name).where("status = 'call'")
    one = d.groupBy("path").agg(F.count("*").alias("n")).select(F.lit("definition").alias("section"), "path", "n")
    two = calls.groupBy("path").agg(F.count("*").alias("n")).select(F.lit("caller").alias("section"), "path", "n")
    deps = c.imports.join(d.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n")).select(F.lit("dependent").alias("section"), "path", "n")
    return one.unionByName(two).unionByName(deps)


INTENTS = (("callers", ("who calls", "callers of", "used by", "usages of")), ("blast_radius", ("what breaks", "impact of", "blast radius", "depends on")), ("define", ("where is", "definition of", "defined", "what is")))


def classify(task: str) -> tuple[str, list[str]]:
    """The intent of a task and the identifiers and quoted strings in it, three at most."""
    import re

    low = task.lower()
    found = re.findall(r"[`\"']([^`\"']{2,80})[`\"']", task)
    found += [w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", task) if re.search(r"_|[a-z][A-Z]", w) and w not in found]
    return next((k for k, phrases in INTENTS if any(p in low for p in phrases)), "overview"), found[:3]


def compass(c: Corpus, task: str, max_files: int = 5) -> DataFrame:
    """section, path, line_num, text: what a task asks for, by its intent; falls back from definitions to words to file names."""
    intent, names = classify(task)
    parts = []
    for n in names:
        if intent in ("define", "overview", "blast_radius"):
            parts.append(c.named(n).where("kind != 'import'").select(F.lit("definition").alias("section"), "path", F.col("line_start").alias("line_num"), F.col("detail").alias("text")))
        if intent in ("callers", "overview", "blast_radius"):
            parts.append(graph.callers(c.lines, c.named(n), n).where("status = 'call'").select(F.lit("caller").alias("section"), "path", "line_num", F.col("line").alias("text")))
        if intent == "blast_radius":
            parts.append(blast(c, n).where("section = 'dependent'").select("section", "path", F.col("n").cast("int").alias("line_num"), F.lit("").alias("text")))
    if not names or intent == "overview":
        hits = search.ranked(c.lines, task, max_files)
        parts.append(hits.select(F.lit("file").alias("section"), "path", "line_num", F.col("line").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context(c: Corpus, task: str) -> DataFrame:
    """Definitions, callers, ranked files and the lines around their best hits, for a task of 3 to 1024 characters."""
    if not 3 <= len(task) <= 1024:
        raise ValueError("a task has 3 to 1024 characters")
    hits = search.ranked(c.lines, task, 5).select("path", "line_num")
    near = search.context_lines(c.lines, hits).select(F.lit("snippet").alias("section"), "path", "line_num", F.col("line").alias("text"))
    return compass(c, task).unionByName(near)


def snapshot(c: Corpus) -> DataFrame:
    """path, json: a row a file with its outline and imports."""
    s = c.symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "line_start", "line_end"))).alias("symbols"))
    d = c.imports.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    f = c.files.select("path", T.language(F.col("path")).alias("language"), F.size(T.lines(F.col("content"))).alias("line_count"), F.octet_length("content").alias("byte_size"))
    j = f.join(s, "path", "left").join(d, "path", "left")
    return j.select("path", F.to_json(F.struct("path", "language", "line_count", "byte_size", "symbols", "imports")).alias("json"))
