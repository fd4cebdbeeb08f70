"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import edit, graph, index, outline, search, versions
from corvid.plans.pipeline import Corpus, Pipeline
from corvid.plans import pipeline as P
from corvid.sources import corpus
from corvid.sources.corpus import CODE_SQL, LINES_SQL, TEXT_FILES_SQL
from corvid.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
UP, LOW = T.UPPER, T.LOWER
FOLD = f"translate(line, '{UP}', '{LOW}')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(s: SparkSession, d: str) -> DataFrame:
    return corpus.text_files(s, d)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return corpus.lines(corpus.text_files(s, d))


def _code(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = corpus.code_files(s, d)
    return files, outline.symbols(files)


def _log(s: SparkSession, d: str) -> DataFrame:
    e = corpus.table(s, d, "events")
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("value").alias("size"), F.col("ts").alias("timestamp"))


LOG_SQL = "log AS (SELECT 'user_' || user_id AS path, event_id AS seq, event_type AS op, value AS size, ts AS timestamp FROM events)"
SUB = r"""string_split(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN t LIKE '\_%' ESCAPE '\' THEN substr(t, 2) ELSE t END, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '_', ' '), ' ')"""
PARTS = f"""list_filter(list_transform(CASE WHEN length(t) >= 4 AND regexp_matches(t, '[A-Z_]') THEN CASE WHEN t LIKE '\\_%' ESCAPE '\\' AND substr(t, 2, 1) <> '_' THEN list_prepend('_' || {SUB}[1], {SUB}[2:]) ELSE {SUB} END ELSE [] END, lambda x: lower(x)), lambda x: length(x) >= 2)"""
TOK = LINES_SQL + ", tok AS (SELECT path, line_num, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS t FROM lines), toks AS (SELECT * FROM tok WHERE length(t) >= 2)"
POST = TOK + f", post AS (SELECT DISTINCT unnest(list_prepend(lower(t), {PARTS})) AS word, path, line_num FROM toks)"


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines")
def lines(s, d):
    return _lines(s, d)


@query(f"WITH {TEXT_FILES_SQL} SELECT path, len(string_split(content, chr(10))) AS line_count, octet_length(CAST(encode(content) AS BLOB)) AS byte_size FROM files")
def line_counts(s, d):
    return _files(s, d).select("path", F.size(T.lines(F.col("content"))).cast("long").alias("line_count"), F.octet_length("content").cast("long").alias("byte_size"))


@query(f"WITH {POST} SELECT word, path, line_num FROM post")
def word_postings(s, d):
    return index.word_postings(_lines(s, d))


@query(f"WITH {TOK} SELECT path, count(*) AS doc_len FROM toks GROUP BY path")
def doc_lengths(s, d):
    return index.doc_lengths(_lines(s, d)).where("doc_len > 0")


@query(f"WITH {POST} SELECT word, path, line_num FROM post WHERE word = 'the'")
def word_lookup(s, d):
    return index.word_lookup(index.word_postings(_lines(s, d)), "The")


@query(f"WITH {POST} SELECT word, path, line_num FROM post WHERE starts_with(word, 'thest') AND word <> 'thest'")
def word_prefix(s, d):
    return index.word_prefix(index.word_postings(_lines(s, d)), "thest")


IDENT = "SELECT p_partkey, unnest([p_name, replace(p_name, ' ', '_'), '_' || replace(p_name, ' ', ''), 'HTTP' || replace(p_type, ' ', '') || p_size, replace(p_brand, '#', 'No')]) AS raw FROM part"


@query(f"WITH x AS ({IDENT}), tok AS (SELECT p_partkey, unnest(regexp_extract_all(raw, '[A-Za-z0-9_]+')) AS t FROM x) SELECT p_partkey, t AS token, array_to_string({PARTS}, ',') AS parts FROM tok WHERE length(t) >= 2")
def subtokens(s, d):
    p = corpus.table(s, d, "part")
    raw = F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit(""))), F.concat(F.lit("HTTP"), F.replace("p_type", F.lit(" "), F.lit("")), F.col("p_size").cast("string")), F.replace("p_brand", F.lit("#"), F.lit("No")))).alias("raw")
    t = p.select("p_partkey", raw).select("p_partkey", F.explode(T.words(F.col("raw"))).alias("token")).where(F.length("token") >= 2)
    return t.select("p_partkey", "token", F.array_join(T.subtokens(F.col("token")), ",").alias("parts"))


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE contains({FOLD}, 'thand')")
def search_literal(s, d):
    return search.literal(_lines(s, d), "ThAnd")


SCORE = f"""CASE WHEN path LIKE '%.md' OR path LIKE '%.json' THEN least(s, 1.0) * 0.5 ELSE s END"""
RERANK = LINES_SQL + f""", hits AS (SELECT path, line_num, line, (length(line) - length(replace({FOLD}, 'thand', ''))) / 5.0 AS s FROM lines WHERE contains({FOLD}, 'thand')),
scored AS (SELECT path, line_num, line, round(CAST({SCORE} AS DOUBLE), 6) AS score FROM hits)"""


@query(f"WITH {RERANK} SELECT * FROM scored ORDER BY score DESC, path, line_num LIMIT 50")
def search_literal_reranked(s, d):
    return search.reranked(_lines(s, d), "thand", 50)


@query(f"WITH {RERANK} SELECT * FROM scored ORDER BY score DESC, path, line_num LIMIT 20 OFFSET 20")
def search_page2(s, d):
    return search.search(_lines(s, d), "thand", 20, 20)


@query(f"WITH {RERANK}, k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line_num) AS k FROM scored) SELECT path, line_num, line, score FROM k WHERE k <= 1 ORDER BY score DESC, path, line_num LIMIT 200")
def per_file_cap(s, d):
    return search.search(_lines(s, d), "thand", 200, max_per_file=1)


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE regexp_matches(line, '\\b[Tt]h[a-z]+nd (of|the)\\b')")
def search_regex(s, d):
    return search.regex(_lines(s, d), r"\b[Tt]h[a-z]+nd (of|the)\b")


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')")
def search_whole_word(s, d):
    return search.whole_word(_lines(s, d), "the")


COMMENT = r"""(trim(translate(line, chr(9) || chr(13), '  '), ' ') = '' OR (path LIKE '%.py' AND starts_with(trim(translate(line, chr(9) || chr(13), '  '), ' '), '#')) OR (path LIKE '%.ts' AND regexp_matches(trim(translate(line, chr(9) || chr(13), '  '), ' '), '^(//|/\*|\*)')))"""


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE NOT {COMMENT}")
def search_compact(s, d):
    return search.compact(_lines(s, d))


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE regexp_matches(path, '^src[1-3]/[^/]*/doc_[^/]*\\.(py|md)$') AND contains({FOLD}, 'tion')")
def search_glob_filtered(s, d):
    return search.literal(search.glob(_lines(s, d), "src[1-3]/*/doc_*.{py,md}"), "tion")


BM25 = TOK.replace("toks AS", "toks0 AS") + """, toks AS (SELECT * FROM toks0),
terms AS (SELECT unnest(['thand', 'attion', 'reed']) AS word),
hits AS (SELECT DISTINCT word, path, line_num FROM (SELECT unnest(list_prepend(lower(t), """ + PARTS + """)) AS word, path, line_num FROM toks) WHERE word IN (SELECT word FROM terms)),
tf AS (SELECT word, path, count(*) AS tf, min(line_num) AS first FROM hits GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
len AS (SELECT f.path, CAST(coalesce(n, 0) AS DOUBLE) AS dl FROM files f LEFT JOIN (SELECT path, count(*) AS n FROM toks GROUP BY path) USING (path)),
tot AS (SELECT count(*) AS n, avg(dl) AS a FROM len),
part AS (SELECT tf.path, tf, first, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / a)) + 0.5) AS p FROM tf JOIN df USING (word) JOIN len ON len.path = tf.path, tot),
score AS (SELECT path, sum(p) AS s, max({'tf': tf, 'neg': -first}) AS b FROM part GROUP BY path)"""
FACTOR = "CASE WHEN path LIKE '%.md' THEN 0.6 ELSE 1.0 END"


@query(f"WITH {BM25}, r AS (SELECT path, -b.neg AS line_num, round(s * {FACTOR}, 6) AS score FROM score ORDER BY 3 DESC, 1 LIMIT 20) SELECT r.path, r.line_num, line, r.score FROM r JOIN lines ON lines.path = r.path AND lines.line_num = r.line_num")
def bm25_ranked(s, d):
    return search.ranked(_lines(s, d), "thand attion reed")


@query(f"WITH {BM25} SELECT path, round(s, 6) AS score, CAST(-b.neg AS INTEGER) AS best_line FROM score")
def bm25_best_line(s, d):
    q = s.range(1).select(F.lit(0).alias("query_id"), F.array(F.lit("thand"), F.lit("attion"), F.lit("reed")).alias("terms"))
    return search.bm25_scores(_lines(s, d), q).select("path", F.round("score", 6).alias("score"), "best_line")


BATCH = BM25.replace("terms AS (SELECT unnest(['thand', 'attion', 'reed']) AS word)", "q AS (SELECT DISTINCT item_id, lower(t) AS word FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM benchmark) WHERE length(t) >= 6), terms AS (SELECT DISTINCT word FROM q)")
BATCH = BATCH.replace("part AS (SELECT tf.path,", "part AS (SELECT item_id, tf.path,").replace("JOIN len ON len.path = tf.path, tot)", "JOIN len ON len.path = tf.path JOIN q USING (word), tot)").replace("score AS (SELECT path, sum(p) AS s, max({'tf': tf, 'neg': -first}) AS b FROM part GROUP BY path)", "score AS (SELECT item_id, path, sum(p) AS s FROM part GROUP BY item_id, path)")


@query(f"WITH {BATCH}, r AS (SELECT item_id, path, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, path) AS k FROM score) SELECT item_id AS query_id, path, score FROM r WHERE k <= 5")
def bm25_batch(s, d):
    from pyspark.sql import Window as W

    terms = F.array_distinct(F.transform(F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 6), lambda w: F.lower(w)))
    q = corpus.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    r = search.bm25_scores(_lines(s, d), q, best=5).select("query_id", "path", F.round("score", 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


WHOLE = BATCH.replace("SELECT DISTINCT item_id, lower(t) AS word FROM (", "SELECT DISTINCT item_id, unnest(list_prepend(lower(t), " + PARTS + ")) AS word FROM (").replace("length(t) >= 6", "length(t) >= 2")


@query(f"WITH {WHOLE}, r AS (SELECT item_id, path, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, path) AS k FROM score) SELECT item_id AS query_id, path, score FROM r WHERE k <= 5")
def bm25_batch_whole(s, d):
    """As bm25_batch, by all words of the passages and their parts."""
    from pyspark.sql import Window as W

    each = F.transform(F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 2), lambda w: F.concat(F.array(F.lower(w)), T.subtokens(w)))
    q = corpus.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.flatten(each)).alias("terms"))
    r = search.bm25_scores(_lines(s, d), q, best=5).select("query_id", "path", F.round("score", 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


TRI = TEXT_FILES_SQL + f""", ch AS (SELECT path, string_split(translate(content, '{UP}', '{LOW}'), '') AS c FROM files),
g AS (SELECT path, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM ch),
grams AS (SELECT DISTINCT path, gram FROM g WHERE NOT regexp_matches(gram, '^[ \\t\\n\\v\\f\\r]+$'))"""


@query(f"WITH {TRI} SELECT path, count(*) AS n FROM grams GROUP BY path")
def trigram_postings_stats(s, d):
    return index.trigrams(_files(s, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {TRI} SELECT path FROM grams WHERE gram IN ('tha', 'han', 'and', 'nd ', 'd r', ' re') GROUP BY path HAVING count(*) = 6")
def trigram_candidates(s, d):
    return index.candidates_in(_files(s, d), "thand re")


@query(f"WITH {TRI} SELECT path FROM grams WHERE gram IN ('tha', 'han', 'and', 'ree', 'eed') GROUP BY path HAVING count(*) = 5")
def regex_candidates(s, d):
    return index.candidates_in(_files(s, d), pattern=r"thand\s+x?reed")


@query(f"WITH {TEXT_FILES_SQL}, ch AS (SELECT string_split(content, '') AS c FROM files), p AS (SELECT unnest(list_transform(range(1, len(c)), lambda i: {{'a': c[i], 'b': c[i + 1]}})) AS z FROM ch), n AS (SELECT z.a AS a, z.b AS b, count(*) AS n FROM p GROUP BY ALL) SELECT a, b, n, CAST(65024 - floor(n * 60928 / (SELECT max(n) FROM n)) AS INTEGER) AS weight FROM n")
def pair_freq(s, d):
    return index.pair_frequencies(_files(s, d))


@query()
def sparse_ngrams(s, d):
    f = _files(s, d)
    return index.sparse_ngrams(f, index.pair_frequencies(f))


@query(f"WITH {TEXT_FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^src1/(.*/)?doc_[0-4][^/]*\\.py$')")
def glob_paths(s, d):
    return search.glob(_files(s, d).select("path"), "src1/**/doc_[0-4]*.py")


URLS_SQL = "urls AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages)"


def _urls(s: SparkSession, d: str) -> DataFrame:
    return corpus.table(s, d, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "").alias("path")).distinct()


@query(f"WITH {TEXT_FILES_SQL} SELECT split_part(substr(path, 6), '/', 1) AS name, contains(substr(path, 6), '/') AS is_dir, count(*) AS n_files FROM files WHERE starts_with(path, 'src1/') GROUP BY ALL")
def ls_dir(s, d):
    return search.ls(_files(s, d), "src1")


@query(f"WITH {URLS_SQL}, p AS (SELECT path, string_split(path, '/') AS a FROM urls), dirs AS (SELECT DISTINCT array_to_string(a[1:k], '/') AS path FROM (SELECT a, unnest(range(1, len(a))) AS k FROM p)) SELECT path, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth, true AS is_dir FROM dirs UNION ALL SELECT path, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER), false FROM urls")
def tree(s, d):
    return search.tree(_urls(s, d))


@query(f"WITH {TEXT_FILES_SQL} SELECT CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.json' THEN 'json' ELSE 'typescript' END AS language, count(*) AS n FROM files GROUP BY 1")
def detect_language(s, d):
    return _files(s, d).groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query(f"WITH {URLS_SQL} SELECT path, NOT (path = '' OR starts_with(path, '/') OR contains(path, '..')) AS safe, false AS sensitive, regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/') AS test FROM urls")
def path_filters(s, d):
    return _urls(s, d).select("path", T.is_safe(F.col("path")).alias("safe"), T.is_sensitive(F.col("path")).alias("sensitive"), T.is_test(F.col("path")).alias("test"))


@query()
def fuzzy_find(s, d):
    return search.fuzzy_find(corpus.table(s, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("/")).alias("path")), "red wid", 50)


@query()
def find_files(s, d):
    return search.find_files(_urls(s, d), "therin 77", 20)


@query(f"WITH {TEXT_FILES_SQL} SELECT count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, count(DISTINCT regexp_extract(path, '[^.]*$')) AS languages FROM files")
def status(s, d):
    return search.status(_files(s, d))


@query(f"WITH {RERANK}, h AS (SELECT path, line_num FROM scored ORDER BY score DESC, path, line_num LIMIT 20), w AS (SELECT DISTINCT path, unnest(range(line_num - 2, line_num + 3)) AS n FROM h) SELECT path, line_num, line FROM lines WHERE (path, line_num) IN (SELECT path, n FROM w)")
def context_lines(s, d):
    ln = _lines(s, d)
    return search.context_lines(ln, search.reranked(ln, "thand", 20))


@query(f"WITH {CODE_SQL} SELECT path, name, 'function' AS kind, line_start, line_end FROM defs UNION ALL SELECT src, replace(replace(dst, '/', '.'), '.py', ''), 'import', CAST(row_number() OVER (PARTITION BY src ORDER BY CAST(regexp_extract(dst, '_([0-9]+)', 1) AS INTEGER)) AS INTEGER), CAST(row_number() OVER (PARTITION BY src ORDER BY CAST(regexp_extract(dst, '_([0-9]+)', 1) AS INTEGER)) AS INTEGER) FROM edges")
def outline_symbols(s, d):
    return _code(s, d)[1].select("path", "name", "kind", "line_start", "line_end")


@query(f"WITH {CODE_SQL} SELECT path, name, 'function' AS kind, line_start, line_end, 0 AS rank FROM defs WHERE name = 'supply_7'")
def symbol_lookup(s, d):
    syms = outline.symbols(corpus.code_files(s, d), "supply_7")
    return outline.find_symbol(syms, "supply_7").select("path", "name", "kind", "line_start", "line_end", "rank")


@query(f"WITH {CODE_SQL}, c AS (SELECT src, caller, callee, row_number() OVER (PARTITION BY src ORDER BY CAST(regexp_extract(dst, '_([0-9]+)', 1) AS INTEGER)) AS k FROM edges) SELECT path, CAST(line_start + k AS INTEGER) AS line_num, name AS scope_name, 'function' AS scope_kind, line_start AS scope_start, line_end AS scope_end FROM c JOIN defs ON path = src WHERE starts_with(callee, 'supply_')")
def enclosing_scope(s, d):
    files, syms = _code(s, d)
    hits = corpus.lines(files).where(F.col("line").rlike(r"^ +supply_\d+\(")).select("path", "line_num")
    return outline.enclosing(hits, syms).select("path", "line_num", "scope_name", "scope_kind", "scope_start", "scope_end")


def _imports(s: SparkSession, d: str) -> DataFrame:
    files, syms = _code(s, d)
    return graph.imports(syms, files)


@query(f"WITH {CODE_SQL} SELECT src, dst FROM edges")
def import_edges(s, d):
    return _imports(s, d)


@query(f"WITH {CODE_SQL} SELECT src AS path FROM edges WHERE dst = 'supp/s_7.py'")
def imported_by(s, d):
    return _imports(s, d).where("dst = 'supp/s_7.py'").select(F.col("src").alias("path"))


REACH = CODE_SQL + """, r1 AS (SELECT DISTINCT src AS path FROM edges WHERE dst = 'region/r_2.py'), r2 AS (SELECT DISTINCT src AS path FROM edges WHERE dst IN (SELECT path FROM r1)), r3 AS (SELECT DISTINCT src AS path FROM edges WHERE dst IN (SELECT path FROM r2)),
reach AS (SELECT path, 1 AS depth FROM r1 UNION ALL SELECT path, 2 FROM r2 UNION ALL SELECT path, 3 FROM r3)"""


@query(f"WITH {REACH} SELECT path, depth FROM reach")
def transitive_dependents(s, d):
    return graph.dependents(_imports(s, d), "region/r_2.py")


@query(f"WITH {CODE_SQL}, a AS (SELECT DISTINCT dst AS path FROM edges WHERE src = 'part/p_3.py'), b AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM a)), c AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM b)) SELECT path, 1 AS depth FROM a UNION ALL SELECT path, 2 FROM b UNION ALL SELECT path, 3 FROM c")
def transitive_deps(s, d):
    return graph.dependencies(_imports(s, d), "part/p_3.py")


@query(f"WITH {REACH} SELECT depth, count(*) AS files FROM reach GROUP BY depth")
def blast_radius(s, d):
    return graph.blast_radius(_imports(s, d), "region/r_2.py")


def _calls(s: SparkSession, d: str) -> DataFrame:
    files, syms = _code(s, d)
    return graph.call_edges(syms, files)


@query(f"WITH {CODE_SQL} SELECT caller, callee, src AS from_path, dst AS to_path, CAST(1 AS DOUBLE) AS weight FROM edges")
def call_edges(s, d):
    return _calls(s, d)


@query(f"WITH {CODE_SQL} SELECT dst AS path, CAST(count(*) AS DOUBLE) AS centrality FROM edges GROUP BY dst")
def call_centrality(s, d):
    return graph.centrality(_calls(s, d))


@query(f"WITH {CODE_SQL} SELECT callee, dst AS to_path FROM edges WHERE caller = 'part_3'")
def callees_unambiguous(s, d):
    return graph.callees(_calls(s, d), "part_3").select("callee", "to_path")


@query(f"WITH {CODE_SQL}, c AS (SELECT src, callee, row_number() OVER (PARTITION BY src ORDER BY CAST(regexp_extract(dst, '_([0-9]+)', 1) AS INTEGER)) AS k FROM edges) SELECT src AS path, CAST(line_start + k AS INTEGER) AS line_num, 'call' AS status FROM c JOIN defs ON path = src WHERE callee = 'supply_7' UNION ALL SELECT path, line_start, 'definition' FROM defs WHERE name = 'supply_7'")
def callers(s, d):
    files = corpus.code_files(s, d)
    return graph.callers(corpus.lines(files), outline.symbols(files, "supply_7"), "supply_7").where("status in ('call', 'definition')").select("path", "line_num", "status")


@query(f"WITH {LOG_SQL} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(size, seq) AS size, arg_max(timestamp, seq) AS timestamp FROM log GROUP BY path")
def version_latest(s, d):
    return versions.latest(_log(s, d))


@query(f"WITH {LOG_SQL} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(size, seq) AS size, arg_max(timestamp, seq) AS timestamp FROM log WHERE seq <= 5000 GROUP BY path")
def version_as_of(s, d):
    return versions.as_of(_log(s, d), 5000)


@query(f"WITH {LOG_SQL} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(size, seq) AS size, arg_max(timestamp, seq) AS timestamp FROM log WHERE seq > 9000 GROUP BY path")
def changes_since(s, d):
    return versions.changes_since(_log(s, d), 9000)


@query(f"WITH {LOG_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM log) SELECT path, seq, op, size, timestamp FROM k WHERE k <= 5")
def version_cap(s, d):
    return versions.history(_log(s, d), 5)


@query(f"WITH {LOG_SQL} SELECT path, max(seq) AS seq FROM log GROUP BY path ORDER BY 2 DESC, 1 LIMIT 25")
def hot_files(s, d):
    return versions.hot(_log(s, d), 25)


DIFF_SQL = LOG_SQL + ", a AS (SELECT path, arg_max(timestamp, seq) AS mtime, arg_max(size, seq) AS size FROM log WHERE seq <= 4000 AND op <> 'error' GROUP BY path), b AS (SELECT path, arg_max(timestamp, seq) AS mtime, arg_max(size, seq) AS size FROM log WHERE seq > 2000 AND op <> 'error' GROUP BY path)"


@query(f"WITH {DIFF_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR NOT (a.mtime = b.mtime OR a.size = b.size)")
def snapshot_diff(s, d):
    log = _log(s, d).where("op <> 'error'")
    snap = lambda x: versions.latest(x).select("path", F.col("timestamp").alias("mtime"), "size", F.xxhash64("size").alias("hash"))
    return versions.snapshot_diff(snap(log.where("seq <= 4000")), snap(log.where("seq > 2000")))


@query("SELECT seq, ts AS timestamp FROM (SELECT ts, row_number() OVER (ORDER BY ts, 'user_' || user_id) AS seq FROM events)")
def version_append(s, d):
    log = _log(s, d)
    return versions.append(log.where("false"), log.drop("seq")).select("seq", "timestamp")


@query(f"WITH {RERANK} SELECT * FROM scored WHERE regexp_matches(path, '^src[0-9]/.*\\.py$') ORDER BY score DESC, path, line_num LIMIT 10")
def pipeline_glob_search_limit(s, d):
    return Pipeline(Corpus(_files(s, d))).glob("src?/**/*.py").search("thand", 200).limit(10).rows()


@query(f"WITH {CODE_SQL}, f AS (SELECT 'nation/n_3.py' AS path UNION SELECT src FROM edges WHERE dst = 'nation/n_3.py') SELECT path, name, line_start, line_end FROM defs WHERE path IN (SELECT path FROM f)")
def pipeline_deps_outline(s, d):
    files, syms = _code(s, d)
    p = Pipeline(Corpus(files, syms, graph.imports(syms, files))).filter(regex="^nation/n_3[.]py$").deps().outline()
    return p.rows().where("kind = 'function'").select("path", "name", "line_start", "line_end")


@query(f"WITH {LINES_SQL} SELECT path, line_num, line FROM lines WHERE starts_with(path, 'src1/en/doc_1.') AND line_num BETWEEN 2 AND 6")
def read_range(s, d):
    return edit.read_range(_lines(s, d), "src1/en/doc_1.py", 2, 6)


TURNS_SQL = "turns AS (SELECT 'conv_' || conv_id AS path, turn, text FROM conversations), ln AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY turn) AS INTEGER) AS line_num, text AS line FROM turns)"


@query(f"WITH {TURNS_SQL} SELECT path, line_num, CASE line_num WHEN 1 THEN '# edited' ELSE line END AS line FROM ln")
def edit_apply(s, d):
    from pyspark.sql import Window as W

    c = corpus.table(s, d, "conversations")
    path = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    ln = c.select(path.alias("path"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("line_num"), F.col("text").alias("line"))
    edits = ln.select("path").distinct().select("path", F.lit("replace").alias("op"), F.lit(1).alias("first"), F.lit(1).alias("last"), F.lit("# edited").alias("text"))
    return edit.apply_edits(ln, edits)


@query()
def snapshot_json(s, d):
    files, syms = _code(s, d)
    return P.snapshot(Corpus(files, syms, graph.imports(syms, files)))


@query()
def context_compose(s, d):
    files, syms = _code(s, d)
    return P.context(Corpus(files, imports=graph.imports(syms, files)), "what breaks if supply_7 changes")


@query()
def lock_grants(s, d):
    e = corpus.table(s, d, "events")
    asked = e.select(F.concat(F.lit("file_"), (F.col("user_id") % 50).cast("string")).alias("path"), F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return changes.lock_grants(asked, 600.0)


@query("""WITH e AS (SELECT 'agent_' || user_id AS agent, ts FROM events), g AS (SELECT agent, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY agent ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e),
k AS (SELECT agent, ts, sum(new) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT agent, min(ts) AS first, max(ts) AS last, count(*) AS beats FROM k GROUP BY agent, k""")
def agent_timeouts(s, d):
    e = corpus.table(s, d, "events").select(F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent"), "ts")
    return changes.sessions(e, "6 hours")
