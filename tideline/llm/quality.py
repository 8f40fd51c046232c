"""Quality rules with host verdicts (operator 10), in DataFrame functions only.

Every document gets counts and rule failures of its own. The failures are summed by host (here: the column
`source`), each rule's rate is shrunk to an empirical Beta prior that is fitted over all hosts, and a host whose
shrunk rate for any rule exceeds `host_limit` is rejected with all its documents.

Defined cases: null text is empty (0 words: fails); a null host gets no verdict; repeated rows are judged one by
one; an empty table gives an empty result; further columns are ignored by `judge` and kept by `keep`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, fresh, lookup_join, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def _covered(positions: Column, width: int) -> Column:
    """How many places the windows of a width that start at these sorted positions cover."""
    steps = F.transform(positions, lambda p, k: F.coalesce(F.least(F.get(positions, k + 1) - p, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_twin(sorted_pairs: Column) -> Column:
    """Of structs (x, i) sorted by x, the i of those whose x a neighbour shares."""
    x = lambda k: F.get(sorted_pairs, k)["x"]
    twins = F.filter(sorted_pairs, lambda s, k: F.coalesce(F.when(k > 0, x(k - 1)) == s["x"], F.lit(False)) | F.coalesce(x(k + 1) == s["x"], F.lit(False)))
    return F.transform(twins, lambda s: s["i"])


def features(docs: DataFrame, text: str = "text", width: int = 5, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep + n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows are hashed first; only windows whose hash recurs are compared as text, so the count is exact and a
    text without repeats never builds its windows."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    d = docs.select(*keep, F.col(text).alias("__t")).withColumn("__w", words_of(F.col("__t")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.withColumn("__l", lines).withColumn("n_words", F.size("__w").cast("long"))
    w = F.col("__w")
    at = F.sequence(F.lit(0), F.size(w) - width)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    d = d.withColumn("__h", F.when(F.size(w) >= width, hashes))
    h = F.col("__h")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    d = d.withColumn("__c", _with_twin(F.col("__s")))
    texts = F.sort_array(F.transform(F.col("__c"), lambda i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("x"), i.alias("i"))))
    d = d.withColumn("__e", texts)
    d = d.withColumn("__p", F.sort_array(_with_twin(F.col("__e"))))
    return d.select(
        *keep, "n_words", F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("__p"), width), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    n = F.col
    return {
        "few_words": n("n_words") < MIN_WORDS,
        "repeats": 100 * n("n_repeat_words") > MAX_REPEAT_PERCENT * n("n_words"),
        "symbols": 100 * n("n_symbols") > MAX_SYMBOL_PERCENT * n("word_chars"),
        "dup_lines": 100 * n("n_dup_lines") > MAX_DUP_LINE_PERCENT * n("n_lines"),
    }


def base_failed() -> Column:
    return failures()["few_words"] | failures()["repeats"]


def host_rates(feats: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs and, for each rule, failures and the shrunk rate. One row per host; hosts are pre-aggregated
    before the shuffle, and the prior is one row."""
    hosts = feats.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(c).alias(f"{r}_failed") for r, c in failures().items()])
    share = lambda r: F.col(f"{r}_failed") / F.col("n_docs")
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(share(r)).alias(f"{r}_m"), F.var_pop(share(r)).alias(f"{r}_v"))])
    one = lambda df: df.withColumn("__one", F.lit(1))
    both = one(hosts).join(F.broadcast(one(prior)), "__one")  # the prior is one row
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.col(f"{r}_v")
        strength = F.when(v <= 0, F.lit(PRIOR_MAX)).otherwise(F.greatest(F.least(m * (1 - m) / v - 1, F.lit(PRIOR_MAX)), F.lit(PRIOR_MIN)))
        both = both.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + m * strength) / (F.col("n_docs") + strength))
    return both.select(host, "n_docs", *[f"{r}_failed" for r in RULES], *[f"{r}_rate" for r in RULES])


def bad_hosts(rates: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    return rates.where(F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > host_limit).select(host, F.lit(True).alias("__bad"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed and kept. The texts are read once; the narrow counts
    are written and read again for the host sums and the verdicts."""
    scratch = Scratch(docs.sparkSession)
    feats = scratch.table(features(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))), "quality")
    bad = scratch.table(bad_hosts(host_rates(feats), host_limit=host_limit), "bad_hosts")
    out = lookup_join(feats, bad, "source", F.col("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.col("__bad").isNull()).alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that judge() keeps, with all their columns. The rows are written once beside their counts, from
    which the host sums are made and the verdicts joined, so that counts are made once and no text is shuffled."""
    scratch = Scratch(docs.sparkSession)
    (row,) = fresh(docs, "__row")
    inner = docs.select(F.struct(*docs.columns).alias(row), F.col(host).alias("source"), F.col(text).alias("text"))
    feats = scratch.table(features(inner, keep=(row, "source")), "quality")
    bad = scratch.table(bad_hosts(host_rates(feats.drop(row)), host_limit=host_limit), "bad_hosts")
    return lookup_join(feats.where(~base_failed()), bad, "source", F.xxhash64(row)).where(F.col("__bad").isNull()).select(f"{row}.*")


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Base counts and host verdicts again, over the tables as DuckDB sees them.
FEATURES_SQL = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
l AS (SELECT doc_id, source, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM c WHERE c > 1),
r AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM p GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE f1) AS a, count(*) FILTER (WHERE f2) AS b, count(*) FILTER (WHERE f3) AS c, count(*) FILTER (WHERE f4) AS d
  FROM x WHERE source IS NOT NULL GROUP BY source),
u AS (UNPIVOT h ON a, b, c, d INTO NAME rule VALUE k),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM u GROUP BY rule),
s AS (SELECT source, n, k, m, CASE WHEN v <= 0 THEN 10000 ELSE greatest(least(m * (1 - m) / v - 1, 10000), 2) END AS s FROM u JOIN m USING (rule)),
bad AS (SELECT DISTINCT source FROM s WHERE (k + m * s) / (n + s) > 0.5)"""

ORACLE_SQL = "WITH " + FEATURES_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND bad.source IS NULL AS kept
FROM x LEFT JOIN bad ON x.source = bad.source"""
