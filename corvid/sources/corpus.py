"""Virtual corpora: tables of files (path, content), and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T

MAX_BYTES = 512 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes may be one row group, which one task reads; above it there are enough of them.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores; a table of SPREAD_BYTES or more stays as it is read, so that at most so much is exchanged."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SPREAD_BYTES else df


def files_in(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The text files below a folder: no skipped folders or extensions, no secrets, nothing binary or too large, nothing that ignore rules exclude.

    Files without a byte are not listed, as Spark's reader leaves them out. The rules read like those of version control: the last that fits decides, ``!`` takes back, ``/`` in front anchors, at the end means folders.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = F.lit(root.rstrip("/") + "/")
    path = F.element_at(F.split(F.col("path"), base, 2), -1)
    out = raw.select(path.alias("path"), "content", F.col("modificationTime").alias("modified"))
    out = out.where(T.is_safe(F.col("path")) & ~T.is_skipped(F.col("path")) & ~T.is_sensitive(F.col("path")) & ~ignored(F.col("path"), ignore or []))
    # Binary files go by their bytes; what is not UTF-8 in the others is replaced, and aborts nothing.
    return out.where(~T.looks_binary(F.col("content"))).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def ignored(path, rules: list[str]):  # noqa: ANN001, ANN201
    """Whether ignore rules exclude a path, as one expression."""
    out = F.lit(False)
    for rule in rules:
        r = rule.strip()
        if not r or r.startswith("#"):
            continue
        keep = r.startswith("!")
        r = r[1:] if keep else r
        folder = r.endswith("/")
        r = r.rstrip("/")
        anchored = "/" in r
        body = T.glob_regex(r.lstrip("/") if "/" in r.lstrip("/") else "x/" + r.lstrip("/"))[1:-1].removeprefix("x/")
        expr = ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(expr), F.lit(not keep)).otherwise(out)
    return out


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/lang/doc_<id>, with suffixes that take turns."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".md", ".py", ".json", ".ts")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    return spread(table(spark, sf_dir, "documents")).select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


TEXT_FILES_SQL = """files AS (SELECT source || '/' || lang || '/doc_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.json' ELSE '.ts' END AS path, coalesce(text, '') AS content FROM documents)"""


def lines(files: DataFrame) -> DataFrame:
    """path, line_num (from 1), line."""
    return files.select("path", F.posexplode(T.lines(F.col("content"))).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_num"), "line")


LINES_SQL = TEXT_FILES_SQL + """, lines AS (SELECT path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line_num, unnest(string_split(content, chr(10))) AS line FROM files)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source written from the star schema: a part imports and calls its suppliers, a supplier its nation, a nation its region."""
    t = lambda n: table(spark, sf_dir, n)

    s = lambda c: F.col(c).cast("string")
    one = lambda head, k, up, fn, upfn: F.concat(F.lit(f"import {up}_"), s(k[1]), F.lit(f"\n\n\ndef {fn}_"), s(k[0]), F.lit(f"(x):\n    return {upfn}_"), s(k[1]), F.lit("(x)\n"))
    region = t("region").select(F.concat(F.lit("region/r_"), s("r_regionkey"), F.lit(".py")).alias("path"), F.concat(F.lit("def region_"), s("r_regionkey"), F.lit("(x):\n    return x\n")).alias("content"))
    nation = t("nation").select(F.concat(F.lit("nation/n_"), s("n_nationkey"), F.lit(".py")).alias("path"), one("", ("n_nationkey", "n_regionkey"), "region.r", "nation", "region").alias("content"))
    supplier = t("supplier").select(F.concat(F.lit("supp/s_"), s("s_suppkey"), F.lit(".py")).alias("path"), one("", ("s_suppkey", "s_nationkey"), "nation.n", "supply", "nation").alias("content"))
    of = t("lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("k"))
    each = lambda front, back: F.array_join(F.transform("k", lambda x: F.concat(F.lit(front), x.cast("string"), F.lit(back))), "")
    part = of.select(F.concat(F.lit("part/p_"), s("l_partkey"), F.lit(".py")).alias("path"), F.concat(each("import supp.s_", "\n"), F.lit("\n\ndef part_"), s("l_partkey"), F.lit("(x):\n"), each("    supply_", "(x)\n")).alias("content"))
    return region.unionByName(nation).unionByName(supplier).unionByName(part)


#: What the rendered code holds, from the columns it was written from.
CODE_SQL = """pairs AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem),
edges AS (
  SELECT 'part/p_' || p || '.py' AS src, 'supp/s_' || s || '.py' AS dst, 'part_' || p AS caller, 'supply_' || s AS callee FROM pairs JOIN supplier ON s_suppkey = s
  UNION ALL SELECT 'supp/s_' || s_suppkey || '.py', 'nation/n_' || s_nationkey || '.py', 'supply_' || s_suppkey, 'nation_' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/n_' || n_nationkey || '.py', 'region/r_' || n_regionkey || '.py', 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation),
defs AS (
  SELECT 'part/p_' || p || '.py' AS path, 'part_' || p AS name, CAST(count(*) + 3 AS INTEGER) AS line_start, CAST(2 * count(*) + 3 AS INTEGER) AS line_end FROM pairs GROUP BY p
  UNION ALL SELECT 'supp/s_' || s_suppkey || '.py', 'supply_' || s_suppkey, 4, 5 FROM supplier
  UNION ALL SELECT 'nation/n_' || n_nationkey || '.py', 'nation_' || n_nationkey, 4, 5 FROM nation
  UNION ALL SELECT 'region/r_' || r_regionkey || '.py', 'region_' || r_regionkey, 1, 2 FROM region)"""
