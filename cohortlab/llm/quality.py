"""Operator 1: quality rules as a short-circuit cascade."""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table, words

STEMS, DENSITY = (4, 5, 6, 7), 5
LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` (SQL or a column) holds; it may use text and the base columns."""

    name: str
    rejects: str | Column

    def condition(self) -> Column:
        return F.expr(self.rejects) if isinstance(self.rejects, str) else self.rejects


def default_rules(symbols: int = 10, exclaims: int = 20, dup_lines: int = 40) -> list[Rule]:
    """Limits are in per cent: of symbols and exclamation marks to words, of repeated lines to lines."""
    return [
        Rule("symbols", f"100 * n_symbols > {symbols} * n_words"),
        Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
        Rule("repeated_lines", f"100 * n_dup_lines > {dup_lines} * n_lines"),
        Rule("exclamations", f"100 * regexp_count(text, '!') > {exclaims} * n_words"),
    ]


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), F.lower))


def _dense_stems(u: Column, length: int, only: list[str] | None = None) -> Column:
    """The stems of this length that begin at least two of the distinct words u, and DENSITY per mille of them."""
    least = F.greatest(F.lit(2), F.floor((F.size(u) * DENSITY + 999) / 1000).cast("int"))
    stems = F.transform(F.filter(u, lambda x: F.length(x) >= length), lambda x: F.substring(x, 1, length))
    if only is not None:
        stems = F.filter(stems, lambda x: x.isin(only))
    return let(F.sort_array(stems), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - least + 1))))


def _letter_words(text: Column) -> Column:
    """The runs of letters of a text, in lower case."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), LETTERS)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000) -> DataFrame:
    """(toxic, text) of at most most_labels labelled documents, the first in the order of a hash."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_labels)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")  # most_labels rows


def telling(sample: DataFrame, terms: Column, support: int, ratio: int) -> list[str]:
    """The terms of `support` toxic documents that are, with one added to the others, `ratio` times as
    frequent in toxic documents as in others. All that qualify are taken; the sample bounds them."""
    own = sample.select("toxic", F.array_distinct(terms).alias("s"))
    total = own.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") != 1, 1)).alias("c")).first()
    # an outer explode: the filter of a plain one would run before the join, over all documents
    n = own.select("toxic", F.explode_outer("s").alias("term")).filter("term is not null and term <> ''").groupBy("term").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") != 1, 1)).alias("c"))
    good = n.filter((F.col("t") >= support) & (F.col("t") * total["c"] >= ratio * (F.col("c") + 1) * total["t"]))
    return sorted(r["term"] for r in good.collect())


def learn_stems(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000, support: int = 5, ratio: int = 20) -> list[str]:
    """Word stems of 4 to 7 characters that are dense in toxic documents and rare as such in others."""
    terms = let(_distinct_words(F.col("text")), lambda u: F.flatten(F.array(*[_dense_stems(u, k) for k in STEMS])))
    return telling(labelled_sample(docs, labels, most_labels), terms, support, ratio)


def learn_words(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000, support: int = 8, ratio: int = 70) -> list[str]:
    """Words of toxic documents that others hardly have."""
    return telling(labelled_sample(docs, labels, most_labels), _letter_words(F.col("text")), support, ratio)


def word_rule(terms: list[str]) -> Rule:
    """Rejects documents with a learned word."""
    return Rule("toxic_words", F.arrays_overlap(_letter_words(F.col("text")), F.array(*[F.lit(x) for x in terms])) if terms else "false")


def stem_rule(stems: list[str]) -> Rule:
    """Rejects documents in which a learned stem is dense."""
    by_length = {k: [s for s in stems if len(s) == k] for k in STEMS}
    one = lambda u: functools.reduce(lambda a, b: a | b, [F.size(_dense_stems(u, k, own)) > 0 for k, own in by_length.items() if own])
    return Rule("toxic_stems", let(_distinct_words(F.col("text")), one) if stems else "false")


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def count(t: Column) -> Column:
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, count))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    stats = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    out = docs.withColumns({"_w": stats, "_l": lines})
    return out.withColumns(
        {
            "n_words": F.col("_w.n_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.col("_l.n").cast("long"),
            "n_dup_lines": F.col("_l.dup").cast("long"),
            "n_repeat_words": F.col("_w.n_repeat_words").cast("long"),
        }
    ).drop("_w", "_l").withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def rule_costs(sample: DataFrame, rules: list[Rule], times: int = 5) -> list[float]:
    """Seconds a row of each rule's condition: the time of a job that evaluates it `times` times on
    every row of the sample, less that of a job that reads the rows only; the better of two runs.
    Jobs of the same work differ by some ten milliseconds; what is below that counts as that."""
    rows = max(1, sample.count()) * times
    every = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_i"))

    def seconds(condition: Column) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            # inside an aggregate, so that it is evaluated after the explode
            every.agg(F.sum((condition & (F.col("_i") > 0)).cast("int")), F.sum(F.length("text"))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    empty = seconds(F.col("n_words") < 0)
    return [max(seconds(r.condition()) - empty, 0.01) / rows for r in rules]


def cascade_order(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7, cost_rows: int = 200) -> list[Rule]:
    """The rules in the order of their rejections per cost among the rows that reach them.

    Both are estimated on a sample of about sample_rows rows that the base rule lets through, the costs on
    cost_rows of them, by the clock, so rules of about equal rank may change places between runs: the
    rule with the most rejections a second comes first, the next is chosen by what it rejects of
    the rest, and so on. The order decides only what is computed, never which rows are kept.
    """
    n = docs.count()
    if not n:
        return rules
    sample = base_columns(docs.sample(False, min(1.0, sample_rows / n), seed)).filter("not base_failed").cache()
    timed = sample.limit(cost_rows).cache()
    try:
        costs = rule_costs(timed, rules)
        verdicts = [[bool(x) for x in r] for r in sample.select(*[F.coalesce(r.condition(), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()]  # about sample_rows rows
        order, left = [], list(range(len(rules)))
        while left:
            best = min(left, key=lambda i: (-sum(v[i] for v in verdicts) / costs[i], costs[i], rules[i].name))
            order.append(rules[best])
            left.remove(best)
            verdicts = [v for v in verdicts if not v[best]]
        return order
    finally:
        timed.unpersist()
        sample.unpersist()


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, labels: DataFrame | None = None, sample_rows: int = 2000) -> DataFrame:
    """Adds the base columns, base_failed, rejected_by (the first rule in cascade order) and kept.

    Null and empty texts have no words and fail the base rule. Extra columns stay; columns of
    the input named like an added one are replaced. Ties and repeated rows are judged alike, rows
    without a doc_id by their text. An empty table gives an empty result. labels (doc_id, toxic) adds two rules
    that are learned from at most 10,000 labelled documents, of words and of stems; labels that are null or of unknown
    documents are not used, of several for one document the highest counts.
    """
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text", *ADDED)])
    rules = default_rules() if rules is None else rules
    if labels is not None:
        rules = [*rules, word_rule(learn_words(docs, labels)), stem_rule(learn_stems(docs, labels))]
    order = cascade_order(docs, rules, sample_rows)
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        chain = chain.when(rule.condition(), F.lit(rule.name))
    return base_columns(docs).withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull())


ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept", "_w", "_l")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), labels=table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) WHERE r.n > 1 GROUP BY 1),
lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 10000),
du AS (SELECT row_number() OVER () AS id, doc_id, list_distinct(list_transform(w, lambda x: lower(x))) AS u FROM d),
dx AS (SELECT id, doc_id, len(u) AS n, unnest(u) AS x FROM du),
ds AS (SELECT id, doc_id, substr(x, 1, k) AS stem FROM dx, (VALUES (4), (5), (6), (7)) v(k) WHERE length(x) >= k GROUP BY id, doc_id, n, k, stem HAVING count(*) >= greatest(2, (n * 5 + 999) // 1000)),
lt AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic <> 1) AS c FROM du JOIN lab USING (doc_id)),
ln AS (SELECT stem, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic <> 1) AS c FROM ds JOIN lab USING (doc_id) GROUP BY 1),
lx AS (SELECT ln.stem FROM ln, lt WHERE ln.t >= 5 AND ln.t * lt.c >= 20 * (ln.c + 1) * lt.t),
st AS (SELECT DISTINCT doc_id FROM ds JOIN lx USING (stem)),
wx AS (SELECT row_number() OVER () AS id, doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '{LETTERS}'), lambda x: x <> ''))) AS x FROM d),
wn AS (SELECT x, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic <> 1) AS c FROM wx JOIN lab USING (doc_id) GROUP BY 1),
wl AS (SELECT wn.x FROM wn, lt WHERE wn.t >= 8 AND wn.t * lt.c >= 70 * (wn.c + 1) * lt.t),
tw AS (SELECT DISTINCT doc_id FROM wx JOIN wl USING (x)),
s AS (SELECT d.doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
      coalesce(k.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims FROM d LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_dup_lines > 40 * n_lines
       OR 100 * n_exclaims > 20 * n_words OR doc_id IN (SELECT doc_id FROM tw) OR doc_id IN (SELECT doc_id FROM st)) AS kept
FROM f"""
