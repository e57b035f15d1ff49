"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is an expression that is true where a document is to be rejected. Rules own what they look at: besides the measures, which
every row needs for its result, they take it from the raw text (``_text``), inside their own branch. On a sample of ``SAMPLE``
documents (chosen by a hash of the id) each rule is run alone, several times: its cost is the least time that takes above that of
a rule that looks at nothing, in steps of a factor of ``STEP`` from ``FLOOR`` on, so that noise seldom changes the order; its
selectivity is the share it rejects. Rules run in falling order of rejection per cost (ties by name), as branches of one
CASE, so that a document that fails one never reaches those after it. The order changes the work, never the
verdict: a document is kept if no rule rejects it.

Repeated words: three-word windows are hashed in the row; where a sort of the hashes shows a repeat, hashes are
sorted with their positions, neighbours with equal hashes mark theirs, and the covered words are counted.

Results for odd input: a null or empty text has no words and fails the base; so do texts of white space;
a null id is an id like any other; rows that repeat are judged each; an empty table gives no rows. Columns of the input with
the name of a result column, whatever its case, give way.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, functions as F

from .common import flattened, row_of, settled

#: Documents that costs and selectivities are estimated on, at most.
SAMPLE = 1000
GAP = r"[ \t-\r]+"
WORD = r"[^ \t-\r]"
SYMBOL = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Runs of a rule on the sample, seconds below which costs are alike, and the factor between steps of cost.
RUNS, FLOOR, STEP = 3, 0.01, 4

#: Rules besides the base. All are in whole numbers.
RULES = {
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 40 * n_lines",
    "letters": r"2 * length(regexp_replace(_text, r'[^\p{L}]+', '')) < word_chars",
    "lettered_words": r"2 * regexp_count(_text, r'\p{L}[^ \t-\r]*') < n_words",
    "bullets": r"10 * regexp_count(_text, r'(?md)^[ \t]*[-*\u2022] ') > 9 * n_lines",
    "ellipses": r"10 * regexp_count(_text, r'(?md)(\.\.\.|\u2026)[ \t]*$') > 3 * n_lines",
    "few_words": f"size(array_distinct(array_remove(split(_text, r'{GAP}'), ''))) < 15",
}


def measured(docs: DataFrame) -> DataFrame:
    """``_row`` (see common.row_of()), ``_text`` (null as empty) and the measures, all of them long."""
    step = docs.select(row_of(docs), F.coalesce("text", F.lit("")).alias("_text"))
    step = step.withColumns({
        "_words": F.array_remove(F.split("_text", GAP), ""),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)),
    })
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_words") > 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<long>")),
    }).drop("_words", "_lines")
    # Most texts repeat no window; only the others are sorted together with positions.
    step = step.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    step = step.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_hashes")
    near = lambda i: F.get("_sorted", i)["h"]
    repeated = F.filter("_sorted", lambda x, i: (i > 0) & (near(i - 1) == x["h"]) | F.coalesce(near(i + 1) == x["h"], F.lit(False)))
    covered = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return step.withColumn("n_repeat_words", F.when(F.col("_repeats"), F.size(F.array_distinct(covered))).otherwise(0).cast("long")).drop("_sorted", "_repeats")


BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def by_rejection_per_cost(sample: DataFrame, rules: dict[str, str]) -> list[str]:
    """The rules' names in the order in which to run them; ``sample`` has the measures and the raw text, in one partition."""

    def run(rule: str) -> tuple[float, int, int]:
        query = sample.agg(F.count_if(F.expr(rule)).alias("n"), F.count(F.lit(1)).alias("all"))
        times = []
        for _ in range(RUNS):  # the first one compiles
            began = time.perf_counter()
            found = query.first()
            times.append(time.perf_counter() - began)
        return min(times), found["n"], found["all"]

    nothing = run("length(_text) < 0")[0]
    rank = []
    for name, rule in rules.items():
        took, n, total = run(rule)
        rank.append((-(n + 1) / (total + 2) / cost_step(took - nothing), name))
    return [name for _, name in sorted(rank)]


def cost_step(seconds: float) -> int:
    return STEP ** max(0, math.ceil(math.log(max(seconds, FLOOR) / FLOOR, STEP)))


def first_failed(order: list[str], rules: dict[str, str]) -> Column:
    verdict = F.when(F.lit(False), F.lit(""))
    for name in order:
        verdict = verdict.when(F.coalesce(F.expr(rules[name]), F.lit(False)), F.lit(name))
    return verdict


def quality_rules(docs: DataFrame, rules: dict[str, str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs``, the measures, base_failed, failed_rule (null: none) and kept."""
    rules = RULES if rules is None else rules
    share = max(1, docs.count() // max(1, sample))
    few = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(sample)
    return flattened(judged(docs, by_rejection_per_cost(settled(measured(few).coalesce(1)), rules), rules), docs)


def judged(docs: DataFrame, order: list[str], rules: dict[str, str]) -> DataFrame:
    """(_row, _found) with the rules run in this order."""
    rows = measured(docs).withColumn("base_failed", F.expr(BASE))
    rows = rows.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(first_failed(order, rules)))
    return rows.select("_row", F.struct(*MEASURES, "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept")).alias("_found"))


#: The same in SQL. Words and lines are numbered rows; the windows of a text are compared as text.
QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM t),
w3 AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM split WHERE len(ws) >= 3),
w AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM w3),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM w),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT s.doc_id, s.text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
b AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(list_distinct(ws)) AS n_distinct
  FROM m JOIN split s ON m.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 2 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < word_chars
    OR 2 * len(regexp_extract_all(text, '\p{L}[^ \t-\r]*')) < n_words OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-*\x{2022}] ')) > 9 * n_lines
    OR 10 * len(regexp_extract_all(text, '(?m)(\.\.\.|\x{2026})[ \t]*$')) > 3 * n_lines OR n_distinct < 15) AS kept
FROM b
"""
