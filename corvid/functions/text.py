"""Column functions on text, identifiers and paths, and translators from patterns to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes in order; the first that a path ends with wins. Case counts.
LANGUAGES = (
    ("zig", ".zig"), ("python", ".py", ".pyi"), ("typescript", ".ts", ".tsx", ".mts"), ("javascript", ".js", ".jsx", ".mjs", ".cjs"),
    ("cpp", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".mm"), ("c", ".c", ".h", ".m"), ("rust", ".rs"), ("go", ".go"), ("php", ".php"), ("ruby", ".rb"),
    ("hcl", ".tf", ".hcl", ".tfvars"), ("r", ".r", ".R"), ("dart", ".dart"), ("java", ".java"), ("kotlin", ".kt", ".kts"), ("swift", ".swift"),
    ("svelte", ".svelte"), ("vue", ".vue"), ("astro", ".astro"), ("shell", ".sh", ".bash", ".zsh"), ("scss", ".scss", ".sass"), ("css", ".css"), ("sql", ".sql"),
    ("protobuf", ".proto"), ("fortran", ".f90", ".f95", ".f03", ".f"), ("llvm_ir", ".ll"), ("mlir", ".mlir"), ("tablegen", ".td"), ("rescript", ".resi", ".res"),
    ("markdown", ".md"), ("json", ".json"), ("yaml", ".yaml", ".yml"),
)
DOCS = ("markdown", "json", "yaml")
# Folders and suffixes that no corpus takes in, and names that tell secrets.
SKIPPED_DIRS = (
    ".git", ".claude", "node_modules", ".zig-cache", "zig-out", ".next", ".nuxt", ".svelte-kit", "dist", "build", ".build", ".output", "out",
    "__pycache__", ".venv", "venv", ".env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", ".gradle", ".idea", ".vs", "vendor",
    "Pods", ".dart_tool", ".pub-cache", "coverage", ".nyc_output", ".turbo", ".parcel-cache", ".cache", ".tmp", ".temp", ".DS_Store", "bundle",
    ".bundle", ".swc", ".terraform", ".terragrunt-cache", ".serverless", "elm-stuff", ".stack-work", ".cabal-sandbox", ".cargo", "bower_components",
)
SKIPPED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "icns", "webp", "svg", "ttf", "otf", "woff", "woff2", "eot", "zip", "tar", "gz", "bz2", "xz", "7z", "rar",
    "pdf", "doc", "docx", "xls", "xlsx", "pptx", "mp3", "mp4", "wav", "avi", "mov", "flv", "ogg", "webm", "exe", "dll", "so", "dylib", "o", "a", "lib",
    "wasm", "pyc", "pyo", "class", "db", "sqlite", "sqlite3", "lock", "sum",
)
SECRET_NAMES = (
    ".dev.vars", ".envrc", ".npmrc", ".pypirc", ".netrc", ".pgpass", ".htpasswd", "application.properties", "application.yml", "application.yaml",
    "credentials.json", "service-account.json", "secrets.json", "secrets.yaml", "secrets.yml", "id_rsa", "id_ed25519",
)
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "crt", "cer", "der", "crl")


def fold(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def words(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def subtokens(word: Column) -> Column:
    """Parts of a compound identifier of four characters or more: camel case, snake case, acronyms, digits; parts of one character are dropped."""
    parts = F.regexp_extract_all(word, F.lit(r"(?:^_)?(?:[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(0))
    compound = (F.length(word) >= 4) & word.rlike("[A-Z_]")
    return F.when(compound, F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: F.length(p) >= 2)).otherwise(F.array().cast("array<string>"))


def language(path: Column) -> Column:
    out = None
    for name, *ends in LANGUAGES:
        hit = path.endswith(ends[0])
        for e in ends[1:]:
            hit = hit | path.endswith(e)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The basename up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def is_safe(path: Column) -> Column:
    """Relative, without parent steps, backslashes or NUL."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("\0") & ~path.rlike(r"(^|/)\.\.(/|$)")


def is_sensitive(path: Column) -> Column:
    """Whether a path names a secret, whatever the case of its letters."""
    name = fold(basename(path))
    named = name.isin(*SECRET_NAMES) | name.endswith(".env") | name.rlike(r"^\.env[._-]") | name.rlike(r"\.(" + "|".join(SECRET_EXTENSIONS) + r")$")
    return path.rlike(r"(^|/)\.(ssh|gnupg|aws)/") | named


def is_skipped(path: Column) -> Column:
    """Whether a step of the path is a skipped folder (case counts), or its suffix a skipped one (it does not)."""
    folder = r"(^|/)(" + "|".join(map(re.escape, SKIPPED_DIRS)) + r")(/|$)"
    return path.rlike(folder) | fold(path).rlike(r"\.(" + "|".join(SKIPPED_EXTENSIONS) + r")$")


def is_test(path: Column) -> Column:
    p = fold(path)
    return p.rlike(r"(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"(_test|\.test|\.spec|_spec|tests)\.[a-z]+$")


def is_doc(path: Column) -> Column:
    return fold(path).endswith(".md") | fold(path).contains("/docs/")


def is_vendored(path: Column) -> Column:
    return fold(path).rlike(r"(^|/)(vendor|node_modules|third_party)/")


def looks_binary(content: Column) -> Column:
    """Whether there is a NUL among the first 512 bytes (or characters, of a string)."""
    return F.contains(F.substring(content, 1, 512).cast("binary"), F.lit(bytearray(1)))


def is_comment_or_blank(line: Column, lang: Column) -> Column:
    """What `compact` leaves out."""
    t = F.trim(F.translate(line, "\t\r", "  "))
    hashes = lang.isin("python", "ruby", "shell", "yaml", "r", "hcl")
    slashes = lang.isin("zig", "typescript", "javascript", "c", "cpp", "rust", "go", "php", "dart", "java", "kotlin", "swift", "scss", "protobuf", "rescript")
    return (t == "") | (hashes & t.startswith("#")) | (slashes & (t.startswith("//") | t.startswith("/*") | t.startswith("*"))) | (lang.isin("sql") & t.startswith("--"))


def occurrences(line: Column, query: str) -> Column:
    """Non-overlapping, whatever the case of ASCII letters."""
    q = query.translate(str.maketrans(UPPER, LOWER))
    return ((F.length(line) - F.length(F.replace(fold(line), F.lit(q), F.lit("")))) / len(q)).cast("int")


def whole_word(query: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(query)}(?![A-Za-z0-9_])"


def glob_regex(pattern: str) -> str:
    """An anchored expression for a glob: * and ? stay within a segment, ** crosses them, {a,b} is one level deep, classes never match a slash.

    A pattern without a slash is looked for in every folder.
    """
    if "/" not in pattern:
        pattern = "**/" + pattern
    if re.search(r"\{[^{}]*\{", pattern):
        raise ValueError("nested braces are not supported")
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        end = pattern.find("]", i + 2) if c == "[" else pattern.find("}", i) if c == "{" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[^/{body}]" if negated else f"(?!/)[{body}]")
            i = end
        elif c == "{" and end > 0 and "," in pattern[i:end]:
            out.append("(?:")
            depth = end
        elif c == "}" and i == depth and depth:
            out.append(")")
            depth = 0
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def checked_regex(pattern: str) -> str:
    """The pattern, if it keeps to the dialect: no look-around, back-references or named groups, known escapes only."""
    if not pattern:
        raise ValueError("empty pattern")
    for m in re.finditer(r"\\(.)", pattern, re.S):
        if m[1].isalnum() and m[1] not in "dDwWsSbBAzntr0":
            raise ValueError(f"unsupported escape \\{m[1]}")
    if re.search(r"\(\?(?!:)", pattern):
        raise ValueError("groups with (? are not supported")
    re.compile(pattern.replace(r"\z", r"\Z"))
    return re.sub(r"\\(.)", lambda m: r"\x00" if m[1] == "0" else m[0], pattern, flags=re.S)  # the engine knows no \0


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside groups and classes."""
    out, depth, i, inside = [""], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        step = pattern[i : i + 2] if c == "\\" else c
        if not inside:
            depth += (c == "(") - (c == ")")
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += step
        # A bracket right after the opening one is a member of the class.
        if c == "[" and not inside:
            inside, first = True, len(re.match(r"\[\^?\]?", pattern[i:])[0])
            out[-1] += pattern[i + 1 : i + first]
            i += first - 1
        elif c == "]":
            inside = False
        i += len(step)
    return out


def literal_groups(pattern: str) -> list[list[str]] | None:
    """For each alternative the literals that its matches hold; None if one has none, so that nothing can be ruled out."""
    groups = [literal_runs(b) for b in branches(pattern)]
    return None if any(g is None for g in groups) else groups


def literal_runs(pattern: str) -> list[str] | None:
    """Literals of three characters or more that every match holds; None if that cannot be told. Groups, alternatives and optional parts give none."""
    if len(branches(pattern)) > 1 or "(?" in pattern:
        return None
    runs, now, i, depth = [], "", 0, 0
    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else ""
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        plain = bool(c) and c not in "\\.^$*+?()[]{}|" and depth == 0
        if plain and nxt not in ("*", "?", "{"):
            now += c
            if nxt == "+":
                runs, now = [*runs, now], ""
        elif c == "\\" and nxt and not nxt.isalnum() and depth == 0 and pattern[i + 2 : i + 3] not in ("*", "?", "{"):
            now += nxt
            i += 1
        else:
            runs, now = [*runs, now], ""
            if c == "\\":
                i += 1
            elif c == "[":
                i = pattern.find("]", i + 2)
                if i < 0:
                    return None
            elif c == "{":
                i = max(pattern.find("}", i), i)
            depth += (c == "(") - (c == ")")
        i += 1
    return [r for r in runs if len(r) >= 3] or None
