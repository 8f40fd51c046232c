"""Secret scans by a trigram inverted index (operator 7), in DataFrame functions only.

From each rule's regex a Boolean query is derived: alternatives of sets of trigrams that any match contains, letters
folded. Postings (trigram, document) of those trigrams are intersected by counting, and only the candidates that
remain are matched with the regex. Rules without a mandatory trigram scan every document where it lies.

Spans are found as Java's regex engine finds them: leftmost, non-overlapping. Their places come from the lengths of
the pieces between matches, summed in a window over one document's matches.

Defined cases: null text has no spans; repeated rows get the same result each; an empty table gives an empty result;
further columns are ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Rule:
    """group and least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: access and hex carry their least length in the pattern: a run that is too short holds no longer match, so the
#: matches are those of the open pattern that pass. assign doesn't: a short match uses up its text.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

#: Classes and alternatives larger than this count as unknown text.
FEW = 8


def _texts(parsed) -> list[tuple]:
    """What a pattern matches, as alternatives: tuples of characters, None standing for any text."""
    out: list[tuple] = [()]
    for code, arg in parsed:
        if code is op.LITERAL:
            alts = [(chr(arg),)]
        elif code is op.IN and len(arg) <= FEW and all(c is op.LITERAL for c, _ in arg):
            alts = [(chr(x),) for _, x in arg]
        elif code is op.SUBPATTERN:
            alts = _texts(arg[-1])
        elif code is op.BRANCH:
            alts = [t for b in arg[1] for t in _texts(b)]
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = _texts(sub)
            alts = inner + [()] if (low, high) == (0, 1) else [t + (None,) for t in inner] if low else [(None,)]
        elif code is op.AT:
            alts = [()]
        else:
            alts = [(None,)]
        out = [a + b for a in out for b in alts] if len(out) * len(alts) <= 64 * FEW else [a + (None,) for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of folded trigrams that must all occur; None if some match need hold none."""
    alts = set()
    for t in _texts(_parser.parse(pattern)):
        runs = "".join("\n" if c is None else c.lower() for c in t).split("\n")
        alts.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in alts:
        return None
    return sorted((a for a in alts if not any(b < a for b in alts)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str], key: list[str], text: str) -> DataFrame:
    """key + hits: which of the trigrams the folded text holds. Exploded, it is the inverted index of them."""
    low = docs.select(*key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    return low.select(*key, F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams])).alias("hits"))


def candidates(index: DataFrame, key: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """key + kinds: the rules for which all trigrams of some alternative are in the document's postings."""
    terms = [(kind, n, t, len(alt)) for kind, alts in queries.items() for n, alt in enumerate(alts) for t in sorted(alt)]
    terms = index.sparkSession.createDataFrame(terms, "kind string, alt int, trigram string, need int")  # a few rows for each rule
    post = index.select(*key, F.explode("hits").alias("trigram")).distinct()
    met = post.join(F.broadcast(terms), "trigram").groupBy(*key, "kind", "alt").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    return met.where(F.col("n") == F.col("need")).groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def _found(docs: DataFrame, rules: list[Rule], key: list[str], text: str, wanted: Column | None = None) -> DataFrame:
    """key, kind and the lengths (gap before, match, counted group) of every match."""
    parts = []
    for r in rules:
        t, regex = F.col(text), F.lit(r.regex)
        here = t.rlike(r.regex) if wanted is None else F.array_contains(wanted, r.kind) & t.rlike(r.regex)
        m, g = F.regexp_extract_all(t, regex, 0), F.regexp_extract_all(t, regex, r.group)
        zipped = F.arrays_zip(F.slice(F.split(t, r.regex), 1, F.size(m)).alias("p"), m.alias("m"), g.alias("g"))
        lens = F.transform(zipped, lambda x: F.struct(F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("len"), F.char_length(x["g"]).alias("counted")))
        parts.append(F.struct(F.lit(r.kind).alias("kind"), F.when(here, lens).alias("lens")))
    d = docs.select(*key, F.array(*parts).alias("__f")).where(F.exists("__f", lambda x: F.size(x["lens"]) > 0))
    return d.select(*key, F.explode("__f").alias("f")).where(F.size("f.lens") > 0).select(*key, "f.kind", "f.lens")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: doc_id and found, its spans as structs (start, no, end, kind) in order; no: the rule's place."""
    scratch = Scratch(docs.sparkSession)
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    key = ["doc_id", "th"]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    index = scratch.table(postings(d, sorted({t for q in asked.values() for a in q for t in a}), key, "text"), "postings")
    cand = scratch.table(candidates(index, key, asked), "candidates")
    same = d["th"].eqNullSafe(cand["th"]) & d["doc_id"].eqNullSafe(cand["doc_id"])
    near = d.join(cand, same).select(d["doc_id"], d["th"], "text", "kinds")
    found = _found(near, [r for r in rules if r.kind in asked], key, "text", F.col("kinds"))
    if full := [r for r in rules if r.kind not in asked]:
        found = found.unionByName(_found(d, full, key, "text"))
    found = found.dropDuplicates([*key, "kind"])
    each = found.select(*key, "kind", F.posexplode("lens").alias("pos", "x")).select(*key, "kind", "pos", "x.*")
    w = Window.partitionBy(*key, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w).cast("long"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    number = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    each = each.where(F.col("counted") >= least[F.col("kind")])
    span = F.struct((F.col("end") - F.col("len")).alias("start"), number[F.col("kind")].alias("no"), "end", "kind")
    spans = each.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("found"))
    both = index["th"].eqNullSafe(spans["th"]) & index["doc_id"].eqNullSafe(spans["doc_id"])
    return index.join(spans, both, "left").select(index["doc_id"], "found")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [n for n, r in enumerate(rules) if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    d = found.withColumn("__b", F.filter("found", lambda s: s["no"].isin(base)))
    count = lambda k: F.coalesce(F.size(F.filter("__b", lambda s: s["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    text = lambda c: F.coalesce(joined(F.col(c)), F.lit(""))
    none = F.col("found").isNull()
    counts = [F.when(none, F.lit(0)).otherwise(count(r.kind)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return d.select("doc_id", *counts, F.sha2(text("__b"), 256).alias("base_sha256"), text("found").alias("spans"))


def op7(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    parts = []
    for n, r in enumerate(RULES):
        x = "'" + r.regex.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {n} AS no, '{r.kind}' AS kind, {r.least} AS least, {str(r.base).upper()} AS base, unnest(regexp_extract_all(t, {x}, 0)) AS m, unnest(regexp_extract_all(t, {x}, {r.group})) AS g, unnest(string_split_regex(t, {x})[:-2]) AS p, unnest(range(len(regexp_extract_all(t, {x}, 0)))) AS i FROM d")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(parts) + """),
e AS (SELECT *, (sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM m),
s AS (SELECT *, e - length(m) AS b, kind || ':' || (e - length(m))::VARCHAR || ':' || e::VARCHAR AS span FROM e WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY b, no) FILTER (WHERE base) AS bs, string_agg(span, ',' ORDER BY b, no) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""


ORACLE_SQL = _sql()
