"""Mixing sources to target weights by soft membership, with DataFrame functions only.

1. A multinomial logistic regression is fitted on the labelled table: at most ``MAX_LABELLED`` labelled
   documents (the first by a hash of their id), of which distinct words and a few binned counts are
   features; of each domain the ``VOCABULARY`` / domains features that stand out most in it are kept.
   What reaches the driver for the fit is at most one number for each of these documents and features.
   Both bounds are parameters.
2. Every document gets its posterior over the domains, from all words of its whole text. The
   vocabulary is broadcast, its size being bounded.
3. Rates x >= 0, one a document, fit the expected tokens A_d = sum x n p_d to the targets T_d by
   projected-gradient least squares from x = 1: (A-T)' M (A-T) is made small, M being the inverse of
   sum n p p'. The gradient is scaled by 1/n for each document, so that a rate depends on what a document is
   and not on its length, and a step of 1 is right. A rate is the same function of the posterior for all
   documents, so that only the few residuals go to the driver and back, and a
   round is one aggregate over the table of tokens and posteriors.

Documents are told by their id: rows that share id and text are counted, and each gets the same
posterior and rate. Null and empty texts have no tokens and keep the rate 1. A null id is a document
too. Without labelled documents the posterior is even; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import sized, written

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}
MAX_LABELLED, VOCABULARY, LEAST_DF, ROUNDS, TOLERANCE = 20_000, 3072, 5, 24, 1e-7
#: Features less standard deviations from even are noise. Ridge penalty and steps of the fit.
LEAST_Z, RIDGE, STEPS = 3.0, 1e-3, 150
SEED = 7


def domain(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of a table with quality and toxic."""
    of = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col(id_col).alias("id"), of.alias("domain")).where("domain is not null and id is not null")


def _count(text: str, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(F.col(text), F.lit(what), F.lit("")))) / len(what)


def features(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, hash of the text, n_tokens and the array of distinct features of each row.

    Words are counted as spaces plus one, as further uses of the split text would each split it again.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("id", "t", F.trim(F.regexp_replace("t", r"[\x20\x09-\x0D]+", " ")).alias("w"))
    n = F.length("w") - F.length(F.replace(F.col("w"), F.lit(" "), F.lit(""))) + (F.length("w") > 0).cast("int")
    upper = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    t = t.select("id", "t", "w", n.alias("n"), upper.alias("u"), *[_count("t", x).alias(k) for k, x in (("c0", "!!"), ("c1", "|"), ("c2", "###"), ("c3", "\n"))])
    share = lambda x: F.floor(10 * x / F.greatest(F.col("n"), F.lit(1))).cast("string")
    bins = [F.concat(F.lit("\tupper "), F.floor(10 * F.col("u") / F.greatest(F.length("t"), F.lit(1))).cast("string"))]
    bins += [F.concat(F.lit(f"\t{k} "), share(F.col(k))) for k in ("c0", "c1", "c2", "c3")]
    bins += [F.concat(F.lit("\tlength "), F.floor(F.log2(F.col("n") + 1)).cast("string"))]
    return t.select("id", F.xxhash64("t").alias("h"), F.col("n").cast("long").alias("n_tokens"), F.concat(F.array(*bins), F.array_distinct(F.split("w", " "))).alias("f"))


def fit(rows: list[np.ndarray], y: np.ndarray, n_features: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, domain) and biases of a multinomial logistic regression on the features that each document has."""
    if not len(y):
        return np.zeros((n_features, k)), np.zeros(k)
    # A last feature that all have keeps empty rows apart and is the bias.
    size = np.array([len(r) + 1 for r in rows])
    at = np.concatenate([np.append(r, n_features) for r in rows]).astype(np.int64)
    start = np.r_[0, np.cumsum(size)[:-1]]
    n = len(y)
    share = np.bincount(at, minlength=n_features + 1) / n
    scale = 1 / np.sqrt(np.maximum(share * (1 - share), 1 / n))
    scale[-1] = 1.0
    x = scale[at]
    goal = np.eye(k)[y]
    times = lambda w: np.stack([np.add.reduceat(w[at, j] * x, start) for j in range(w.shape[1])], 1)
    back = lambda e: np.stack([np.bincount(at, np.repeat(e[:, j], size) * x, minlength=n_features + 1) for j in range(e.shape[1])], 1) / n
    v = np.random.default_rng(1).random((n_features + 1, 1))
    for _ in range(12):
        v = back(times(v / np.linalg.norm(v)))
    step = 1 / (0.5 * np.linalg.norm(v) + RIDGE)
    w, ahead, t = np.zeros((n_features + 1, k)), np.zeros((n_features + 1, k)), 1.0
    for _ in range(STEPS):
        p = times(ahead)
        p = np.exp(p - p.max(1, keepdims=True))
        new = ahead - step * (back(p / p.sum(1, keepdims=True) - goal) + RIDGE * ahead)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (last - 1) / t * (new - w)
    w *= scale[:, None]
    return w[:-1], w[-1]


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows, by a literal and no RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def train(docs: DataFrame, labelled: DataFrame, id_col: str, text: str, domains: tuple, most: int, vocabulary: int) -> tuple[DataFrame, list[float]]:
    """(feature, what it adds to the log odds of each domain) and the log odds of a document with none of the features."""
    few = labelled.where(F.col("domain").isin(*domains)).orderBy(F.xxhash64("id"), "id", "domain").limit(most)
    few = sized(written(few, "mix-labelled"), 64)
    # Rows that share id and text are one document here.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(few.select("id"), "id", "left_semi").distinct()
    seen = features(rows, "id", "t").join(few, "id").select("id", "h", "domain", F.explode_outer("f").alias("f"))
    seen = written(seen, "mix-features")
    sums = [F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    df = sum([F.col(f"c{k}") for k in range(1, len(domains))], F.col("c0"))
    by = written(seen.groupBy("f").agg(*sums).where(df >= LEAST_DF), "mix-counts")
    size = {r["domain"]: r["count"] for r in seen.select("id", "h", "domain").distinct().groupBy("domain").count().collect()}
    q = (df + 0.5) / (sum(size.values()) + 1.0)
    words = set()
    for k, d in enumerate(domains):
        n = float(size.get(d, 0))
        z = (F.col(f"c{k}") - n * q) / F.sqrt(F.lit(max(n, 1.0)) * q * (1 - q) + 0.25)
        top = by.select("f", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(vocabulary // len(domains))
        words |= {r["f"] for r in top.collect()}
    words = sorted(words)
    spark = docs.sparkSession
    number = F.broadcast(_literal(spark, [{"f": f, "j": j} for j, f in enumerate(words)], "f string, j int"))
    of = seen.join(number, "f", "left").groupBy("id", "h", "domain").agg(F.array_join(F.collect_list(F.col("j").cast("string")), " ").alias("has"))
    got = of.select("domain", "has").collect()
    w, bias = fit([np.array(r["has"].split(), np.int64) for r in got], np.array([domains.index(r["domain"]) for r in got], np.int64), len(words), len(domains))
    lists = [{"f": f} | {f"l{k}": float(x) for k, x in enumerate(w[j])} for j, f in enumerate(words)]
    model = _literal(spark, lists, "f string, " + ", ".join(f"l{k} double" for k in range(len(domains))))
    return written(model, "mix-vocabulary"), bias.tolist()


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", domains: tuple = DOMAINS, most: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> DataFrame:
    """id, h, n_tokens, m (rows that share id and text), p (array of posteriors)."""
    model, bias = train(docs, labelled, id_col, text, domains, most, vocabulary)
    rows = features(docs, id_col, text).select("id", "h", "n_tokens", F.posexplode_outer("f").alias("at", "f")).join(F.broadcast(model), "f", "left")
    sums = [F.sum(F.coalesce(f"l{k}", F.lit(0.0))).alias(f"s{k}") for k in range(len(domains))]
    by = rows.groupBy("id", "h", "n_tokens").agg(F.count_if(F.col("at") == 0).alias("m"), *sums)
    logit = [F.col(f"s{k}") / F.col("m") + bias[k] for k in range(len(domains))]
    by = by.select("id", "h", "n_tokens", "m", *[x.alias(f"s{k}") for k, x in enumerate(logit)])
    top = F.greatest(*[f"s{k}" for k in range(len(domains))])
    power = [F.exp(F.col(f"s{k}") - top) for k in range(len(domains))]
    return by.select("id", "h", "n_tokens", "m", *[(x / sum(power[1:], power[0])).alias(f"p{k}") for k, x in enumerate(power)])


def rates(table: DataFrame, targets: dict[str, float], domains: tuple = DOMAINS, budget: float | None = None, relative: bool = False, max_rate: float | None = None) -> tuple[Column, dict]:
    """The rate as an expression over posteriors(), and what it comes to.

    targets: shares of ``budget`` tokens (all tokens, if None), or with ``relative`` multiples of what each domain has.
    """
    k = len(domains)
    n, m, p = F.col("n_tokens").cast("double"), F.col("m").cast("double"), [F.col(f"p{j}") for j in range(k)]
    first = table.agg(*[F.sum(m * n * x) for x in p], *[F.sum(m * n * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    have = np.array([x or 0.0 for x in first[:k]])
    gram = np.array([x or 0.0 for x in first[k:]]).reshape(k, k)
    goal = np.array([targets.get(d, 0.0) for d in domains])
    goal = goal * have if relative else goal / max(goal.sum(), 1e-12) * (have.sum() if budget is None else budget)
    metric = np.linalg.pinv(gram + np.eye(k) * max(np.trace(gram), 1.0) * 1e-9)
    rate: Column = F.lit(1.0)
    got, best = have, math.inf
    for _ in range(ROUNDS):
        miss = got - goal
        size = float(miss @ metric @ miss)
        if np.abs(miss).max(initial=0) <= TOLERANCE * max(have.sum(), 1.0) or size > best * (1 - 1e-4):
            break
        best = size
        pull = metric @ miss
        rate = F.greatest(F.lit(0.0), rate - F.when(n > 0, sum([float(pull[j]) * p[j] for j in range(1, k)], float(pull[0]) * p[0])).otherwise(0.0))
        rate = F.least(rate, F.lit(float(max_rate))) if max_rate is not None else rate
        got = np.array([x or 0.0 for x in table.agg(*[F.sum(m * n * x * rate) for x in p]).first()])
    return rate, {"before": have.tolist(), "target": goal.tolist(), "after": got.tolist()}


def _chance(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)


def mixing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, **how: object) -> DataFrame:
    """One row per row of docs: id, n_tokens, p_<domain>, rate, copies (the rate rounded up or down by a hash of the id)."""
    table = written(posteriors(docs, domain(labels, id_col), id_col, text), "mix-posteriors")
    rate, _ = rates(table, targets, **how)
    out = table.withColumn("rate", rate).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select(F.col("id").alias(id_col), "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + _chance("id")).cast("long").alias("copies"))


def thin(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, relative: bool = True) -> DataFrame:
    """docs, with its own columns, each row at most once (rates end at 1) and with the chance of its rate."""
    table = written(posteriors(docs, domain(labels, id_col), id_col, text), "mix-posteriors")
    rate, _ = rates(table, targets, relative=relative, max_rate=1.0)
    gone = table.where(F.floor(rate + _chance("id")) < 1).select("id", "h").distinct()
    gone = sized(written(gone, "mix-gone"), 64)
    cols = docs.columns
    id_col, text = (f"c{cols.index(x)}" for x in (id_col, text))
    docs = docs.toDF(*[f"c{k}" for k in range(len(cols))])  # whatever the columns are named
    hit = F.col(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("h"))
    return docs.join(gone, hit, "left_anti").toDF(*cols)
