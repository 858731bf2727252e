"""Quality rules with risk-controlled cutoffs (operator 5), in DataFrame functions only.

Each rule rejects a text if one of its measures is over a cutoff. Cutoffs are chosen from a fixed grid, for each stratum
(language x length class), on labelled rows: going from the mildest cutoff to the strictest, a cutoff is accepted while
the exact binomial bound says that it rejects at most ALPHA / rules of the good texts. The test at each step is
P(Binomial(good texts, ALPHA / rules) <= those rejected) <= DELTA / (strata x rules): Bonferroni over strata and rules, and a
fixed sequence along the grid, which stops at its first failure and so needs no further correction. With probability
1 - DELTA, in every stratum at most ALPHA of good texts are rejected by the method. A stratum with too few labels for any
cutoff has no rule, so it keeps all that passes the base rules.

Defined results: a null text has no words and fails the base rules; rows without a label only receive verdicts; repeated
rows are judged one by one, and a label counts once for each row of its doc_id; an unknown or null language is 'other'; an
empty table gives an empty result. 8-word windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import P, table, text_of, written

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
ALPHA, DELTA = 0.05, 0.05
LANGS = ("en", "de", "fr", "es")
#: Upper ends of the length classes, in words.
LENGTHS = (120, 500)
#: Measures in thousandths, with their cutoffs from mild to strict.
GRID = {
    "symbols": (400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10),
    "uppercase": (900, 800, 700, 600, 500, 400, 350, 300, 250, 200, 150, 120, 100),
    "exclaims": (400, 300, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10),
    "dup_lines": (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100),
    "repeats": (290, 250, 200, 150, 120, 100, 80, 60, 40, 20),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the rules' own measures under P."""
    t = F.col(f"{P}t")
    words, h, s, p = (F.col(f"{P}{x}") for x in ("words", "h", "s", "p"))
    has_word = lambda x: x.rlike("[^ \\t-\\r]")
    df = docs.withColumn(f"{P}t", text_of())
    df = df.withColumn(f"{P}words", F.array_remove(F.split(t, "[ \\t-\\r]+"), "")).withColumn(f"{P}lines", F.filter(F.split(t, "\n"), has_word))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    df = df.withColumn(f"{P}h", F.when(F.size(words) > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))))
    # Only texts with equal windows pay for the sort: equal hashes then stand side by side.
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn(f"{P}s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    near = lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["x"] == e["x"]))
    df = df.withColumn(f"{P}p", F.sort_array(F.array_compact(F.transform(s, lambda e, k: F.when(F.coalesce(near(e, k), F.lit(False)), e["i"])))))
    spans = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(F.lit(WINDOW)).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    lines, n = F.col(f"{P}lines"), F.greatest(F.lit(1), F.col("word_chars"))
    per_mille = lambda x, of: F.floor(x * 1000 / F.greatest(F.lit(1), of)).cast("int")
    df = df.withColumns({
        "word_chars": _without(t, BLANKS).cast("long"),
        "n_symbols": (F.length(t) - _without(t, "#*$%&|<>")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{P}n_lines": F.size(lines),
        f"{P}upper": F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        f"{P}bang": F.length(t) - _without(t, "!"),
    })
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        f"{P}symbols": per_mille(F.col("n_symbols"), n),
        f"{P}uppercase": per_mille(F.col(f"{P}upper"), n),
        f"{P}exclaims": per_mille(F.col(f"{P}bang"), n),
        f"{P}dup_lines": per_mille(F.col("n_dup_lines"), F.col(f"{P}n_lines")),
        f"{P}repeats": per_mille(F.col("n_repeat_words"), F.col("n_words")),
    })
    return df.drop(*(f"{P}{x}" for x in ("t", "words", "lines", "h", "s", "p", "n_lines", "upper", "bang")))


def stratum(lang: Column, n_words: Column) -> Column:
    """One of (len(LANGS) + 1) * (len(LENGTHS) + 1) strata, whatever the data."""
    size = F.when(n_words < LENGTHS[0], "short").when(n_words < LENGTHS[1], "middle").otherwise("long")
    return F.concat_ws("/", F.when(lang.isin(*LANGS), lang).otherwise("other"), size)


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), summed in logarithms; 0 (not small) from k >= n p on, where no test can pass."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(term, a["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["total"] - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(F.aggregate(steps, start, step, lambda a: a["total"]))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest accepted cutoff where there is one. At most strata x rules rows."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias(f"{P}id")).distinct()
    kept = measured.filter(~F.col("base_failed")).select("doc_id", f"{P}stratum", *(f"{P}{r}" for r in GRID))
    points = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(f"{P}{r}") > c).cast("long").alias("over")) for r, g in GRID.items() for c in g))
    counts = (
        kept.join(good, F.col("doc_id") == F.col(f"{P}id"), "left_semi")
        .select(F.col(f"{P}stratum").alias("stratum"), F.inline(points))
        .groupBy("stratum", "rule", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum("over").alias("k"))
    )
    tests = (len(LANGS) + 1) * (len(LENGTHS) + 1) * len(GRID)
    passed = log_binomial_cdf(F.col("n"), F.col("k"), alpha / len(GRID)) <= F.log(F.lit(delta / tests))
    so_far = F.min(passed.cast("int")).over(W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("ok", so_far).filter("ok = 1").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs (doc_id, text, lang, ...) without text, with the measures, base_failed, kept, and the rules that reject."""
    found = measures(docs)
    drop = [c for c in docs.columns if c in ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")]
    found = found.withColumn(f"{P}stratum", stratum(F.col("lang"), F.col("n_words"))).drop(*(c for c in drop if c == "text"))
    found = written(found, "measures")
    picked = cutoffs(found, labels, alpha, delta).groupBy(F.col("stratum").alias(f"{P}s2")).agg(
        *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{P}max_{r}") for r in GRID)
    )
    out = found.join(F.broadcast(picked), F.col(f"{P}stratum") == F.col(f"{P}s2"), "left")
    fails = F.array_compact(F.array(*(F.when(F.col(f"{P}{r}") > F.col(f"{P}max_{r}"), F.lit(r)) for r in GRID)))
    out = out.withColumn("rejected_by", F.array_join(fails, ","))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return out.drop(*(c for c in out.columns if c.startswith(P)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _sql() -> str:
    """The same in SQL: windows as joined words, and the bound from the gamma function."""
    grid = ", ".join(f"({i}, '{r}', {c})" for i, (r, g) in enumerate(GRID.items()) for c in g)
    pick = lambda alias: " ".join(f"WHEN '{r}' THEN {alias}.{r}" for r in GRID)
    tests, p = (len(LANGS) + 1) * (len(LENGTHS) + 1) * len(GRID), ALPHA / len(GRID)
    langs = ", ".join(f"'{x}'" for x in LANGS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM w),
v AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win FROM u),
rep AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v WHERE pos + {WINDOW} <= n) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT pos + j) AS n_repeat_words FROM rep CROSS JOIN range({WINDOW}) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT d.doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^!]', '', 'g')) AS bang
  FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN cover ON cover.doc_id = d.doc_id),
m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols * 1000 // greatest(1, word_chars) AS symbols, upper * 1000 // greatest(1, word_chars) AS uppercase, bang * 1000 // greatest(1, word_chars) AS exclaims,
         n_dup_lines * 1000 // greatest(1, n_lines) AS dup_lines, n_repeat_words * 1000 // greatest(1, n_words) AS repeats,
         CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END || CASE WHEN n_words < {LENGTHS[0]} THEN '/short' WHEN n_words < {LENGTHS[1]} THEN '/middle' ELSE '/long' END AS stratum
  FROM b),
grid(i, rule, cutoff) AS (VALUES {grid}),
c AS (
  SELECT stratum, i, rule, cutoff, count(*) AS n, sum(CASE WHEN CASE rule {pick("m")} END > cutoff THEN 1 ELSE 0 END)::BIGINT AS k
  FROM m CROSS JOIN grid WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
x AS (SELECT *, CASE WHEN k >= n * {p} THEN 0 ELSE ln(list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))) END <= ln({DELTA} / {tests}) AS ok FROM c),
y AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING) AS so_far FROM x),
z AS (SELECT stratum, i, rule, min(cutoff) AS cutoff FROM y WHERE so_far = 1 GROUP BY ALL),
f AS (SELECT m.doc_id, string_agg(rule, ',' ORDER BY i) AS rejected_by FROM m JOIN z ON z.stratum = m.stratum WHERE CASE rule {pick("m")} END > cutoff GROUP BY m.doc_id)
SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM m LEFT JOIN f ON f.doc_id = m.doc_id
"""


OP5_SQL = _sql()
