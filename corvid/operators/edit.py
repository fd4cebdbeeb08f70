"""Reading ranges of lines and editing them, as functions from tables of lines to tables of lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T


def content_hash(lines: DataFrame) -> DataFrame:
    """path, hash of all of a file's lines, whatever order the rows come in."""
    return lines.groupBy("path").agg(F.bit_xor(F.xxhash64("line_num", "line")).alias("hash"))


def read_range(lines: DataFrame, path: str, start: int = 1, end: int | None = None, compact: bool = False, if_hash: int | None = None) -> DataFrame:
    """Lines of a file; none if its hash is the one that the caller has."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines count from 1, and the end is not before the start")
    out = lines.where((F.col("path") == path) & (F.col("line_num") >= start))
    out = out.where(F.col("line_num") <= end) if end is not None else out
    if compact:
        out = out.where(~T.is_comment_or_blank(F.col("line"), T.language(F.col("path"))))
    if if_hash is not None:
        out = out.join(content_hash(lines.where(F.col("path") == path)).where(F.col("hash") != if_hash), "path", "left_semi")
    return out.orderBy("line_num")


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines after edits (path, op, first, last, text): replace or delete first..last, or insert text after line first (0: in front).

    At most one edit may touch a line; text may hold several lines.
    """
    e = edits.withColumn("kept_cr", F.lit(False)).drop("kept_cr")
    cut = e.where(F.col("op").isin("replace", "delete")).select("path", F.explode(F.sequence("first", "last")).alias("line_num"))
    old = lines.join(cut, ["path", "line_num"], "left_anti").select("path", F.col("line_num").cast("double").alias("at"), F.lit(0).alias("k"), "line")
    new = e.where(F.col("op").isin("replace", "insert")).select("path", F.when(F.col("op") == "insert", F.col("first") + 0.5).otherwise(F.col("first").cast("double")).alias("at"), F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    packed = old.unionByName(new).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "k", "line"))).alias("z"))
    return packed.select("path", F.posexplode("z").alias("n", "z")).select("path", (F.col("n") + 1).alias("line_num"), F.col("z.line").alias("line"))


def replace_once(files: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """The file with `old`, which has to stand in it exactly once, replaced; other files stay. Unless it does, ok is false and the content stays."""
    n = (F.length("content") - F.length(F.replace("content", F.lit(old), F.lit("")))) / len(old)
    here = F.col("path") == path
    return files.select("path", F.when(here & (n == 1), F.replace("content", F.lit(old), F.lit(new))).otherwise(F.col("content")).alias("content"), F.when(here, n == 1).otherwise(F.lit(True)).alias("ok"))


def preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that differ between two states of files: path, line_num, old, new."""
    a, b = before.select("path", "line_num", F.col("line").alias("old")), after.select("path", "line_num", F.col("line").alias("new"))
    return a.join(b, ["path", "line_num"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


def health(content: str, lang: str) -> str | None:
    """The first bracket that does not fit, outside strings and comments, or a Python import that is gone while its name is used."""
    pairs, stack, i, line = {")": "(", "]": "[", "}": "{"}, [], 0, 1
    hashes = lang in ("python", "ruby", "shell", "yaml", "r")
    while i < len(content):
        c = content[i]
        if c == "\n":
            line += 1
        elif (hashes and c == "#") or (not hashes and content.startswith("//", i)):
            i = (content.find("\n", i) + len(content) + 1) % (len(content) + 1) - 1
        elif not hashes and content.startswith("/*", i):
            end = content.find("*/", i + 2)
            end = len(content) if end < 0 else end + 1
            line += content.count("\n", i, end)
            i = end
        elif c in "\"'`":
            mark = content[i : i + 3] if content[i : i + 3] in ('"""', "'''") else c
            m = re.compile(rf"(?:\\.|(?!{mark}).)*?{mark}", re.S if len(mark) == 3 or c == "`" else 0).match(content, i + len(mark))
            if m:
                line += m[0].count("\n")
                i = m.end() - 1
        elif c in "([{":
            stack.append((c, line))
        elif c in pairs:
            if not stack or stack[-1][0] != pairs[c]:
                return f"line {line}: unexpected {c}"
            stack.pop()
        i += 1
    return f"line {stack[-1][1]}: {stack[-1][0]} is not closed" if stack else None


def dropped_import(before: str, after: str) -> str | None:
    """A name that a Python file imported before the edit, no longer does, and still uses."""

    def names(t: str) -> set[str]:
        out = set()
        for m in re.finditer(r"^\s*(?:from\s+[.\w]+\s+)?import\s+(.+)$", t, re.M):
            out |= {x.split(" as ")[-1].strip(" ()").split(".")[0] for x in m[1].split(",") if x.strip(" ()")}
        return out

    code = re.sub(r"^\s*(?:from\s+[.\w]+\s+)?import\s+.+$", "", after, flags=re.M)
    bound = set(re.findall(r"^\s*(?:def|class)\s+(\w+)|^\s*(\w+)\s*=", after, re.M))
    bound = {x for pair in bound for x in pair if x}
    return next((x for x in sorted(names(before) - names(after) - bound) if re.search(rf"\b{re.escape(x)}\b", code)), None)
