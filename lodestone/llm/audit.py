"""Filter interaction audit (operator 13): a relational word pipeline, and conditional counts over sets of filters.

Five filters look at a document: A has under MIN_WORDS words; B has few different words; C has many capitals; D holds a
mark; E has the text of a smaller doc_id. Words are exploded, aggregated by (text, word) and then by text to totals
and distincts; the flags of A to D belong to a text, so equal texts are one row from the start, which also finds each text's
least doc_id for E. Documents take their text's flags and their labels by outer joins. One aggregate by source counts, in
32 conditional-count columns each, all documents, good and toxic ones that pass each set of filters. From those
counts every order of the filters is worked out: a step removes what passes the filters before it, less what passes its own too.

Texts are shuffled once, after equal texts of a task have become one; words never are, as (text, word) is aggregated where
the text lies. Documents meet their text's flags by its 128-bit hash under adaptive skew handling, so a text that a third of all rows
share is split. Nothing is collected; a row a source is all that the orders multiply.

Defined cases: a null text is empty (no words: fails A, passes B to D), and equal to other null or empty texts; null doc_ids are no smaller
than others, and neither is equal; repeated rows count one by one; several labels of a doc_id count as one with the greatest values; a
null source is the part with an empty name, as is an empty one; texts of any length are used whole; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, cut

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT, MARKS = 50, 65, 5, r"[#$%&*|]"
SETS = 1 << len(FILTERS)
COUNTED = ("every", "good", "toxic")


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, in two columns."""
    return [F.xxhash64(F.lit(seed), text).alias(f"t{seed}") for seed in (0, 1)]


def text_flags(docs: DataFrame) -> DataFrame:
    """One row for each different text: t0, t1, least (doc_id), n_words, n_distinct and mask (bits of A to D that it fails)."""
    text = F.coalesce("text", F.lit(""))
    # The partial step of this aggregate makes equal texts of a task one before they travel.
    texts = docs.select(*text_key(text), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).groupBy("t0", "t1").agg(F.min("doc_id").alias("least"), F.max("text").alias("text"))
    c = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * CAPITALS_PCT
    d = F.col("text").rlike(MARKS)
    plain = F.when(c, 4).otherwise(0) + F.when(d, 8).otherwise(0)
    # Keys begin with the text, so both aggregates stay where the text already lies. Blank edges of a split are no words.
    # A projection of its own, so that nothing of a text is worked out once a word.
    split = texts.select("t0", "t1", "least", plain.alias("plain"), F.split("text", GAP).alias("words"))
    words = split.select("t0", "t1", "least", "plain", F.explode("words").alias("word"))
    per_word = words.groupBy("t0", "t1", "least", "plain", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    per_text = per_word.groupBy("t0", "t1", "least", "plain").agg(F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_words"), F.count_if(real).alias("n_distinct"))
    a = F.when(F.col("n_words") < MIN_WORDS, 1).otherwise(0)
    b = F.when(F.col("n_distinct") * 100 < F.col("n_words") * DISTINCT_PCT, 2).otherwise(0)
    return per_text.select("t0", "t1", "least", "n_words", "n_distinct", (F.col("plain") + a + b).alias("mask"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of A to E that the document fails), good and toxic of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), *text_key(F.coalesce("text", F.lit(""))))
    # Written once: both sides of the join are then plain exchanges, whose hot partitions Spark can split.
    flags = cut(text_flags(docs).select("t0", "t1", "least", "mask"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = slim.join(flags, ["t0", "t1"], "left")
    mask = F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    both = both.select("doc_id", "part", mask.alias("mask")).join(told, "doc_id", "left")
    return both.select("doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counts_by_part(rows: DataFrame) -> DataFrame:
    """part and every, good and toxic: arrays of 32 counts, by set of filters, of the documents that pass all of the set."""
    when = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.count_if((F.col("mask").bitwiseAND(F.lit(s)) == 0) & when[k]).alias(f"{k}_{s}") for k in COUNTED for s in range(SETS)]
    return rows.groupBy("part").agg(*columns).select("part", *[F.array(*[f"{k}_{s}" for s in range(SETS)]).alias(k) for k in COUNTED])


def _shapley(bit: int) -> Column:
    """Removals of a filter over all orders: a set of n others stands before it in n! * (4 - n)! of them."""
    others = [s for s in range(SETS) if not s & bit]
    n = len(FILTERS)
    terms = [(F.col("every")[s] - F.col("every")[s | bit]) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in others]
    return sum(terms[1:], terms[0])


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from what passes the filters before and with that of the step."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(o, i + 1, bit[f], sum(bit[x] for x in o[:i]), i_f) for o in map("".join, permutations(FILTERS)) for i, f in enumerate(o) for i_f in [FILTERS.index(f)]]
    # 600 rows, fixed by definition; the strings and numbers of a row are cut from one array of text.
    shares = counts.select("*", F.array(*[_shapley(1 << i) for i in range(len(FILTERS))]).alias("shares"))
    each = shares.select("*", F.explode(F.split(F.lit(";".join(",".join(map(str, x)) for x in steps)), ";")).alias("x"))
    each = each.select("*", F.split("x", ",").alias("y")).select("part", *COUNTED, "shares", F.col("y")[0].alias("o"), *[F.col("y")[i].cast("int").alias(c) for i, c in ((1, "s"), (2, "b"), (3, "p"), (4, "i"))])
    passed = lambda k, s: F.get(F.col(k), s)
    before, with_ = F.col("p"), F.col("p").bitwiseOR(F.col("b"))
    removed = lambda k: passed(k, before) - passed(k, with_)
    every = F.lit(SETS - 1)
    return each.select(
        "part",
        F.col("o").alias("filter_order"),
        F.col("s").alias("step"),
        passed("every", with_).alias("kept"),
        removed("every").alias("removed"),
        (passed("every", F.lit(0)) - passed("every", F.col("b")) - removed("every")).alias("redundant"),
        (passed("every", every.bitwiseXOR(F.col("b"))) - passed("every", every)).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("shares", F.col("i")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, alone and after others, in every order, by source."""
    return orders(counts_by_part(flagged(docs, labels)))


#: DuckDB's text of the same, with each order's removals counted document by document.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, l.quality, l.toxic, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
  count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, contains(failed, own) AS hit, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND failed <> '' AS gone, failed, n, good, bad FROM s, g),
p AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM p
"""
