"""Symbols and imports of source files, line by line, with the ends of their bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import batches as B
from corvid.functions import text as T

N = r"([A-Za-z_$][\w$]*)"
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|pub(?:\([^)]*\))?|inline|unsafe|extern|partial|virtual|suspend|data|external|const|declare)\s+)*"


def _r(*rules: tuple[str, str]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p), kind) for p, kind in rules]


_TS = _r((r"^\s*import\b.*?from\s*['\"]([^'\"]+)", "import"), (r"^\s*import\s*['\"]([^'\"]+)", "import"), (r"^\s*(?:const|let|var)\s.*?require\(\s*['\"]([^'\"]+)", "import"), (rf"^\s*{_MOD}function\s*\*?\s*{N}", "function"), (rf"^\s*{_MOD}class\s+{N}", "class_def"), (rf"^\s*{_MOD}interface\s+{N}", "interface_def"), (rf"^\s*{_MOD}enum\s+{N}", "enum_def"), (rf"^\s*{_MOD}type\s+{N}\s*[=<]", "type_alias"), (rf"^\s*{_MOD}(?:const|let|var)\s+{N}", "constant"))
_C = _r((r"^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)", "import"), (rf"^\s*#\s*define\s+{N}", "macro_def"), (rf"^\s*@(?:interface|protocol|implementation)\s+{N}", "class_def"), (rf"^\s*(?:typedef\s+)?struct\s+{N}\s*(?:\{{|$)", "struct_def"), (rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{N}\s*(?:[:{{]|$)", "enum_def"), (rf"^\s*(?:typedef\s+)?union\s+{N}\s*(?:\{{|$)", "union_def"), (rf"^\s*class\s+{N}\s*(?:final\s*)?(?:[:{{]|$)", "class_def"), (rf"^(?!\s*(?:return|if|else|for|while|switch|case|do|goto|typedef)\b)[A-Za-z_][\w\s\*&:<>,~]*?[\s\*&]{N}\s*\([^;]*$", "function"))
RULES: dict[str, list[tuple[re.Pattern, str]]] = {
    "zig": _r((rf"^\s*(?:pub\s+)?(?:export\s+|inline\s+|extern\s+)?fn\s+{N}", "function"), (rf"^\s*(?:pub\s+)?const\s+{N}\s*=\s*(?:packed\s+|extern\s+)?struct\b", "struct_def"), (rf"^\s*(?:pub\s+)?const\s+{N}\s*=\s*enum\b", "enum_def"), (rf"^\s*(?:pub\s+)?const\s+{N}\s*=\s*union\b", "union_def"), (r"^\s*(?:pub\s+)?const\s+\w+\s*=\s*@import\(\"([^\"]+)", "import"), (rf"^\s*(?:pub\s+)?const\s+{N}", "constant"), (r"^\s*test\s+\"([^\"]*)", "test_decl")),
    "python": _r((rf"^\s*(?:async\s+)?def\s+{N}", "function"), (rf"^\s*class\s+{N}", "class_def"), (r"^\s*from\s+([.\w]+)\s+import\b", "import"), (r"^\s*import\s+([.\w]+)", "import")),
    "typescript": _TS, "javascript": _TS, "svelte": _TS, "vue": _TS, "astro": _TS, "c": _C, "cpp": _C,
    "rust": _r((rf"^\s*{_MOD}(?:async\s+)?fn\s+{N}", "function"), (rf"^\s*{_MOD}struct\s+{N}", "struct_def"), (rf"^\s*{_MOD}enum\s+{N}", "enum_def"), (rf"^\s*{_MOD}trait\s+{N}", "trait_def"), (r"^\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?:[\w:<>]+\s+for\s+)?(\w+)", "impl_block"), (rf"^\s*{_MOD}type\s+{N}", "type_alias"), (rf"^\s*(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?{N}", "constant"), (rf"^\s*macro_rules!\s*{N}", "macro_def"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+)", "import"), (rf"^\s*(?:pub\s+)?mod\s+{N}\s*;", "import")),
    "go": _r((rf"^func\s+(?:\([^)]*\)\s*)?{N}", "function"), (rf"^\s*type\s+{N}\s+(?:struct|interface)\b", "struct_def"), (rf"^\s*type\s+{N}", "type_alias"), (r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)", "import"), (rf"^\s*const\s+{N}", "constant"), (rf"^\s*var\s+{N}", "variable")),
    "php": _r((rf"^\s*{_MOD}(?:class|trait)\s+{N}", "class_def"), (rf"^\s*interface\s+{N}", "interface_def"), (rf"^\s*enum\s+{N}", "enum_def"), (rf"^\s*{_MOD}function\s+&?{N}", "function"), (rf"^\s*{_MOD}const\s+(?:\w+\s+)?{N}\s*=", "constant"), (r"^\s*use\s+([\\\w]+)", "import")),
    "ruby": _r((r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "function"), (r"^\s*(?:class|module)\s+([A-Z]\w*)", "struct_def"), (r"^\s*require(?:_relative)?\s*\(?['\"]([^'\"]+)", "import")),
    "hcl": _r((r"^\s*(?:resource|data)\s+\"[^\"]*\"\s+\"([^\"]+)", "struct_def"), (r"^\s*variable\s+\"([^\"]+)", "variable"), (r"^\s*output\s+\"([^\"]+)", "constant"), (r"^\s*module\s+\"([^\"]+)", "import"), (r"^\s*provider\s+\"([^\"]+)", "struct_def")),
    "r": _r((r"^\s*([A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\b", "function"), (r"^\s*(?:setClass|R6Class)\(\s*['\"]([^'\"]+)", "class_def"), (r"^\s*(?:library|require|source)\(\s*['\"]?([\w./]+)", "import")),
    "dart": _r((r"^\s*(?:import|export|part)\s+['\"]([^'\"]+)", "import"), (rf"^\s*typedef\s+{N}", "type_alias"), (rf"^\s*{_MOD}(?:base\s+)?class\s+{N}", "class_def"), (rf"^\s*enum\s+{N}", "enum_def"), (rf"^\s*(?:base\s+)?mixin\s+{N}", "trait_def"), (rf"^\s*extension\s+{N}\s+on\b", "impl_block"), (rf"^\s*(?:static\s+)?(?:const|final)\s+(?:[\w<>?]+\s+)?{N}\s*=", "constant"), (rf"^\s*(?!return|if|for|while|switch|await|else)(?:[\w<>?,]+\s+)+(?:get\s+|set\s+)?{N}\s*(?:\(|=>)", "function")),
    "java": _r((r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "import"), (rf"^\s*{_MOD}(?:class|record)\s+{N}", "class_def"), (rf"^\s*{_MOD}interface\s+{N}", "interface_def"), (rf"^\s*{_MOD}enum\s+{N}", "enum_def"), (rf"^\s*(?!return|new|throw|else|case)(?:[\w<>\[\],.?@]+\s+)+{N}\s*\([^=]*$", "method")),
    "kotlin": _r((r"^\s*import\s+([\w.*]+)", "import"), (rf"^\s*{_MOD}enum\s+class\s+{N}", "enum_def"), (rf"^\s*{_MOD}interface\s+{N}", "interface_def"), (rf"^\s*{_MOD}(?:class|object)\s+{N}", "class_def"), (rf"^\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?{N}", "function"), (rf"^\s*{_MOD}val\s+{N}", "constant"), (rf"^\s*{_MOD}var\s+{N}", "variable")),
    "swift": _r((r"^\s*import\s+([\w.]+)", "import"), (rf"^\s*{_MOD}struct\s+{N}", "struct_def"), (rf"^\s*{_MOD}protocol\s+{N}", "interface_def"), (rf"^\s*{_MOD}(?:class|actor)\s+(?!func){N}", "class_def"), (rf"^\s*{_MOD}enum\s+{N}", "enum_def"), (rf"^\s*(?:{_MOD}|class\s+|mutating\s+)func\s+{N}", "function")),
    "shell": _r((r"^\s*(?:source|\.)\s+(\S+)", "import"), (rf"^\s*function\s+{N}", "function"), (rf"^\s*{N}\s*\(\)", "function"), (rf"^\s*(?:export\s+|local\s+|readonly\s+)?{N}=", "variable")),
    "css": _r((r"^\s*@(?:keyframes|mixin|function)\s+([\w-]+)", "function"), (r"^\s*(\$[\w-]+|--[\w-]+)\s*:", "constant"), (r"^\s*([.#][\w-]+)[^;{]*\{", "class_def")),
    "sql": _r((r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp\w*\s+)?(?:table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)", "struct_def"), (r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", "constant"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`]?([\w.]+)", "function"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?trigger\s+[\"`]?([\w.]+)", "method"), (r"(?i)^\s*create\s+type\s+[\"`]?([\w.]+)", "type_alias")),
    "protobuf": _r((r"^\s*import\s+(?:public\s+|weak\s+)?\"([^\"]+)", "import"), (rf"^\s*message\s+{N}", "struct_def"), (rf"^\s*enum\s+{N}", "enum_def"), (rf"^\s*service\s+{N}", "interface_def"), (rf"^\s*rpc\s+{N}", "method")),
    "fortran": _r((r"(?i)^\s*use\s+(?:,\s*\w+\s*::\s*)?(\w+)", "import"), (r"(?i)^\s*module\s+(?!procedure\b)(\w+)", "class_def"), (r"(?i)^\s*(?!end\b)(?:[\w()*]+\s+)*(?:program|subroutine|function)\s+(\w+)", "function"), (r"(?i)^\s*type\s*(?:,[^:]*)?(?:::)?\s*(\w+)\s*$", "struct_def")),
    "llvm_ir": _r((r"^\s*(?:define|declare)\b[^@]*@([\w.$-]+)", "function"), (r"^\s*@([\w.$-]+)\s*=", "variable"), (r"^\s*%([\w.$-]+)\s*=\s*type\b", "type_alias")),
    "mlir": _r((r"^\s*(?:builtin\.)?module\s+@([\w.$-]+)", "class_def"), (r"^\s*(?:\w+\.)?func\b[^@]*@([\w.$-]+)", "function")),
    "tablegen": _r((r"^\s*include\s+\"([^\"]+)", "import"), (rf"^\s*(?:defm|def)\s+{N}", "constant"), (rf"^\s*(?:multiclass|class)\s+{N}", "class_def"), (rf"^\s*let\s+{N}", "variable")),
    "rescript": _r((r"^\s*(?:open|include)\s+([\w.]+)", "import"), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s*)*module\s+type\s+{N}", "interface_def"), (rf"^\s*module\s+{N}", "struct_def"), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s*)*type\s+(?:rec\s+)?{N}", "type_alias"), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s*)*external\s+{N}", "function"), (rf"^\s*(?:let|and)\s+(?:rec\s+)?{N}.*=>", "function"), (rf"^\s*(?:let|and)\s+(?:rec\s+)?{N}", "constant")),
}
RULES["scss"] = RULES["css"]
#: What lines of Python that count begin with: what a rule asks for, and quotes.
_PYTHON_STARTS = ("def", "class", "from", "import", "async", '"', "'", *"rRbBuU")
_DOCSTRING = re.compile(r"[rRbBuU]*(\"\"\"|\'\'\')")
ONE_LINE = {"import", "variable", "constant", "type_alias", "macro_def"}


def _end(lines: list[str], start: int, kind: str, lang: str) -> int:
    """Number of the last line of a symbol that begins on line `start` (both from 0)."""
    if kind in ONE_LINE:
        return start
    indent = len(lines[start].expandtabs(4)) - len(lines[start].expandtabs(4).lstrip())
    if lang == "python":
        last = start
        for k in range(start + 1, len(lines)):
            t = lines[k].expandtabs(4)
            if not t.strip() or t.lstrip().startswith("#"):
                continue
            if len(t) - len(t.lstrip()) <= indent:
                break
            last = k
        return last
    if lang == "ruby":
        for k in range(start + 1, len(lines)):
            t = lines[k].expandtabs(4)
            if t.strip() == "end" and len(t) - len(t.lstrip()) <= indent:
                return k
        return start
    depth, opened, quote, block = 0, False, "", False
    for k in range(start, len(lines)):
        if not opened and k - start >= 10:
            return start
        t, i = lines[k], 0
        while i < len(t):
            c = t[i]
            if block:
                if t.startswith("*/", i):
                    block, i = False, i + 1
            elif quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = ""
            elif t.startswith("//", i):
                break
            elif t.startswith("/*", i):
                block, i = True, i + 1
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return k
            i += 1
        if quote != "`":
            quote = ""
    return start


def outline(path_lang: str, content: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, source line) of the symbols of a file in order; lines from 1."""
    rules = RULES.get(path_lang)
    if not rules:
        return []
    lines, out, until, go_imports = content.split("\n"), [], "", False
    for k, raw in enumerate(lines):
        line = raw.rstrip("\r")
        if until:
            if until in line:
                until = ""
            continue
        s = line.strip()
        if path_lang == "python":
            m = re.match(r"[rRbBuU]*(\"\"\"|''')", s)
            if m:
                if s.count(m[1]) < 2:
                    until = m[1]
                continue
        elif s.startswith("/*"):
            if "*/" not in s:
                until = "*/"
            continue
        if not s or s.startswith("//") or (s.startswith("#") and path_lang not in ("c", "cpp", "css", "scss")):
            continue
        if path_lang == "go":
            if re.match(r"import\s*\(", s):
                go_imports = True
                continue
            if go_imports:
                if s.startswith(")"):
                    go_imports = False
                elif m := re.search(r"\"([^\"]+)", s):
                    out.append((m[1], "import", k + 1, k + 1, line))
                continue
        for pattern, kind in rules:
            if m := pattern.search(line):
                if path_lang == "rust" and kind == "function" and k and re.search(r"#\[(?:tokio::)?test", "\n".join(lines[max(0, k - 3) : k])):
                    kind = "test_decl"
                out.append((m[1].strip(), kind, k + 1, _end(lines, k, kind, path_lang) + 1, line))
                break
    return out


SCHEMA = "path string, ord int, name string, kind string, line_start int, line_end int, detail string"
_ARROW = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int32()) for x in SCHEMA.split(", ")])


def texts(files: DataFrame) -> DataFrame:
    """path, lang and content."""
    return files.select("path", T.language(F.col("path")).alias("lang"), "content")


def symbols(files: DataFrame, name: str | None = None) -> DataFrame:
    """One row a symbol: path, ord, name, kind, line_start, line_end, detail. With a name, only of files that hold it, as a symbol is named by a part of its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from B.out(((path, k, *s) for path, lang, t in B.each(batches) for k, s in enumerate(outline(lang, t or ""))), _ARROW)

    held = files if name is None else files.where(F.col("content").contains(name))
    return texts(held).mapInArrow(run, SCHEMA)


def rank() -> Column:
    """How far down a definition stands among those of its name: by kind, then by what its path says."""
    k = F.col("kind")
    base = F.when(k.isin("function", "method", "class_def", "struct_def", "enum_def", "union_def", "trait_def", "interface_def"), 0).when(k.isin("type_alias", "macro_def"), 10).when(k == "impl_block", 30)
    base = base.when(k.isin("constant", "variable"), 45).when(k == "test_decl", 70).when(k == "import", 90).otherwise(45)
    p = F.col("path")
    return base + F.when(T.is_test(p), 25).otherwise(0) + F.when(F.lower(p).rlike("(^|/)examples?/"), 20).otherwise(0) + F.when(T.is_vendored(p), 50).otherwise(0) + F.when(T.is_doc(p), 40).otherwise(0)


def find_symbol(syms: DataFrame, name: str) -> DataFrame:
    """All definitions of a name (case counts), best first."""
    return syms.where(F.col("name") == name).withColumn("rank", rank()).orderBy("rank", "path", "line_start")


def enclosing(hits: DataFrame, syms: DataFrame) -> DataFrame:
    """Each (path, line_num) with the smallest symbol around it, or else the nearest one before it."""
    s = syms.where("kind != 'import'").select("path", "ord", F.col("name").alias("scope_name"), F.col("kind").alias("scope_kind"), F.col("line_start").alias("scope_start"), F.col("line_end").alias("scope_end"))
    j = hits.join(s, (hits.path == s.path) & (F.col("scope_start") <= F.col("line_num")), "left").drop(s.path)
    inside = F.col("scope_end") >= F.col("line_num")
    order = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("scope_end") - F.col("scope_start")).otherwise(F.col("line_num") - F.col("scope_start")), F.col("ord"))
    w = W.partitionBy("path", "line_num").orderBy(order)
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "ord")
