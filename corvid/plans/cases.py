"""Queries whose rows meet every branch of the rules on paths, scores and ranks: paths are dealt by a row's key, so that SQL can say what each should give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.operators import index, outline, search
from corvid.plans import dialects
from corvid.plans.registry import LOG_SQL, ORACLE_SQL, POST, QUERIES, query
from corvid.sources import corpus
from corvid.sources.storage import shared_dir
from corvid.streaming import changes

__all__ = ["ORACLE_SQL", "QUERIES"]

#: path ({} is the key), language, skipped, sensitive, test, doc, vendored, ignored by IGNORE, score of a line with one hit of "alpha", factor of the path for "alpha".
IGNORE = ["*.log", "!keep.log", "/top/", "# a remark", "tmp*/"]
PATHS = (
    ("d{}/src/alpha.py", "python", 0, 0, 0, 0, 0, 0, 16.0, 1.6),
    ("d{}/src/alphabet.ts", "typescript", 0, 0, 0, 0, 0, 0, 9.0, 1.6),
    ("d{}/alpha/main.rs", "rust", 0, 0, 0, 0, 0, 0, 7.0, 1.0),
    ("d{}/src/main.go", "go", 0, 0, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/tests/main.py", "python", 0, 0, 1, 0, 0, 0, 0.6, 0.6),
    ("d{}/src/main_test.go", "go", 0, 0, 1, 0, 0, 0, 0.6, 0.6),
    ("d{}/examples/main.rb", "ruby", 0, 0, 0, 0, 0, 0, 0.6, 1.0),
    ("d{}/vendor/main.php", "php", 1, 0, 0, 0, 1, 0, 0.4, 0.4),
    ("d{}/vendor/tests/alpha.c", "c", 1, 0, 1, 0, 1, 0, 3.84, 0.384),
    ("d{}/docs/guide.md", "markdown", 0, 0, 0, 1, 0, 0, 0.5, 0.6),
    ("d{}/alpha.json", "json", 0, 0, 0, 0, 0, 0, 0.5, 1.6),
    ("d{}/al.java", "java", 0, 0, 0, 0, 0, 0, 9.0, 1.0),
    ("d{}/conf/.env", "unknown", 1, 1, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/conf/Secrets.YML", "unknown", 0, 1, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/keys/ID_RSA", "unknown", 0, 1, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/keys/site.PEM", "unknown", 0, 1, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/img/photo.PNG", "unknown", 1, 0, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/node_modules/m.js", "javascript", 1, 0, 0, 0, 1, 0, 0.4, 0.4),
    ("d{}/run/one.log", "unknown", 0, 0, 0, 0, 0, 1, 1.0, 1.0),
    ("d{}/run/keep.log", "unknown", 0, 0, 0, 0, 0, 0, 1.0, 1.0),
    ("top/d{}/x.kt", "kotlin", 0, 0, 0, 0, 0, 1, 1.0, 1.0),
    ("d{}/top/x.swift", "swift", 0, 0, 0, 0, 0, 0, 1.0, 1.0),
    ("d{}/tmp7/x.sh", "shell", 0, 0, 0, 0, 0, 1, 1.0, 1.0),
)
_NAMES = ("path", "language", "skipped", "sensitive", "test", "doc", "vendored", "ignored", "score", "factor")
_ROWS = ", ".join("(" + ", ".join([str(k), *(repr(x) if isinstance(x, str) else str(x) for x in row)]) + ")" for k, row in enumerate(PATHS))
PATHS_SQL = f"rule(k, {', '.join(_NAMES)}) AS (VALUES {_ROWS}), dealt AS (SELECT o_orderkey AS key, o_orderkey % 3 + 1 AS hits, o_orderkey % 5 = 0 AS named, rule.* REPLACE (replace(path, '{{}}', CAST(o_orderkey AS VARCHAR)) AS path) FROM orders JOIN rule ON k = o_orderkey % {len(PATHS)})"


def _dealt(s: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    front = F.array(*[F.lit(row[0].split("{}")[0]) for row in PATHS])
    back = F.array(*[F.lit(row[0].split("{}")[1]) for row in PATHS])
    k = (key % len(PATHS)).cast("int")
    path = F.concat(front[k], key.cast("string"), back[k])
    return corpus.table(s, d, "orders").select(key.alias("key"), (key % 3 + 1).cast("int").alias("hits"), path.alias("path"))


@query(f"WITH {PATHS_SQL} SELECT path, language, skipped = 1 AS skipped, sensitive = 1 AS sensitive, test = 1 AS test, doc = 1 AS doc, vendored = 1 AS vendored, ignored = 1 AS ignored FROM dealt")
def path_rules(s, d):
    p = F.col("path")
    flags = {"skipped": T.is_skipped, "sensitive": T.is_sensitive, "test": T.is_test, "doc": T.is_doc, "vendored": T.is_vendored}
    return _dealt(s, d).select("path", T.language(p).alias("language"), *[f(p).alias(n) for n, f in flags.items()], corpus.ignored(p, IGNORE).alias("ignored"))


@query(f"""WITH {PATHS_SQL}, f AS (SELECT *, CASE WHEN test = 1 THEN 0.6 ELSE 1 END * CASE WHEN path LIKE '%/examples/%' THEN 0.6 ELSE 1 END * CASE WHEN vendored = 1 THEN 0.4 ELSE 1 END AS less FROM dealt)
SELECT path, 1 AS line_num, CASE WHEN language IN ('markdown', 'json') THEN 0.5 ELSE CAST(round(CAST(score AS DOUBLE) + (hits - 1 + CASE WHEN named THEN 5 ELSE 0 END) * less, 6) AS DOUBLE) END AS score FROM f""")
def rerank_rules(s, d):
    rows = _dealt(s, d).withColumn("line", F.repeat(F.lit("Alpha, "), F.col("hits"))).withColumn("line_num", F.lit(1))
    syms = rows.where("key % 5 = 0").select("path", F.lit("ALPHA").alias("name"), F.lit(1).alias("line_start"))
    return search.reranked(rows.select("path", "line_num", "line"), "alpha", 1 << 30, symbols=syms).select("path", "line_num", "score")


@query(f"WITH {PATHS_SQL} SELECT path, round(CAST(factor AS DOUBLE), 6) AS factor FROM dealt")
def bm25_path_boost(s, d):
    return _dealt(s, d).select("path", F.round(search.path_factor(["al", "alpha"]), 6).alias("factor"))


_KINDS = (("function", 0), ("class_def", 0), ("type_alias", 10), ("impl_block", 30), ("constant", 45), ("test_decl", 70), ("import", 90))
_KIND_SQL = ", ".join(f"({k}, '{n}', {r})" for k, (n, r) in enumerate(_KINDS))


@query(f"""WITH {PATHS_SQL}, kinds(j, kind, base) AS (VALUES {_KIND_SQL})
SELECT path, kind, CAST(base + 25 * test + 20 * (path LIKE '%/examples/%')::INT + 50 * vendored + 40 * doc AS INTEGER) AS rank FROM dealt JOIN kinds ON j = key % {len(_KINDS)}""")
def symbol_rank(s, d):
    kinds = F.array(*[F.lit(n) for n, _ in _KINDS])
    rows = _dealt(s, d).select("path", kinds[(F.col("key") % len(_KINDS)).cast("int")].alias("kind"), F.lit("alpha").alias("name"), F.lit(1).alias("line_start"))
    return outline.find_symbol(rows, "alpha").select("path", "kind", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {dialects.SYMBOLS_SQL} SELECT 'of/' || n_nationkey || '.' || ext AS path, replace(name, '_@', '_' || n_nationkey) AS name, kind, line_start, line_end FROM want, nation")
def outline_languages(s, d):
    return outline.symbols(dialects.files(s, d)).select("path", "name", "kind", "line_start", "line_end")


def _text_lines(s: SparkSession, d: str) -> DataFrame:
    return corpus.lines(corpus.text_files(s, d))


@query(f"WITH {POST} SELECT word, path, line_num FROM post WHERE path NOT LIKE 'src0/%'")
def index_removed(s, d):
    """Postings less those of a folder's files, which are put back and taken out once more."""
    post = index.word_postings(_text_lines(s, d))
    gone = corpus.text_files(s, d).where(F.col("path").startswith("src0/"))
    back = index.replaced(post, gone, post.where(F.col("path").startswith("src0/")))
    return index.without(back, gone).select("word", "path", "line_num")


@query(f"WITH {POST}, n AS (SELECT word, count(*) AS n FROM post GROUP BY word) SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(strlen(word)) AS BIGINT) AS key_bytes FROM n")
def index_size(s, d):
    return index.size(index.word_postings(_text_lines(s, d)), "word")


def _all_of(words: list[str]) -> str:
    return " AND ".join(f"contains(c, '{g}')" for w in words for g in index.grams_of(w))


@query(f"""WITH {corpus.TEXT_FILES_SQL}, f AS (SELECT path, translate(content, '{T.UPPER}', '{T.LOWER}') AS c FROM files)
SELECT path FROM f WHERE ({_all_of(['the ', 'tion'])}) OR ({_all_of(['eaux'])})""")
def regex_or_candidates(s, d):
    return index.candidates_in(corpus.text_files(s, d), pattern=r"the [a|b]+tion|eaux\b")


@query(f"WITH {LOG_SQL} SELECT path, max(seq) AS seq, max_by(op, seq) AS op, max_by(size, seq) AS size FROM log GROUP BY path")
def stream_changes(s, d):
    """The feed as a stream that runs until it has read all files there are; each batch leaves the state of all paths in the shared folder."""
    import uuid

    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    schema = corpus.table(s, d, "events").schema
    e = changes.event_stream(s, f"{d}/events.parquet*", schema)
    log = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("value").alias("size"))
    out = changes.latest_versions(log).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    out.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return s.read.parquet(f"{at}/out")


ORACLE_SQL["lock_grants"] = """WITH RECURSIVE r AS (
  SELECT 'file_' || user_id % 50 AS path, 'agent_' || user_id AS agent, epoch_us(ts) / 1e6 AS "at", row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, 'agent_' || user_id) AS k FROM events),
g AS (SELECT path, agent, "at", k, true AS granted, agent AS holder, "at" + 600.0 AS until FROM r WHERE k = 1
  UNION ALL SELECT r.path, r.agent, r."at", r.k, g.holder = r.agent OR r."at" >= g.until,
    CASE WHEN g.holder = r.agent OR r."at" >= g.until THEN r.agent ELSE g.holder END, CASE WHEN g.holder = r.agent OR r."at" >= g.until THEN r."at" + 600.0 ELSE g.until END
  FROM g JOIN r ON r.path = g.path AND r.k = g.k + 1)
SELECT path, agent, "at", granted FROM g"""
