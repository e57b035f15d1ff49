"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Lines are what '\\n' separates. A window is three consecutive lines of a document with one word at least in them. Of
equal windows anywhere, the one with the smallest (doc_id, position) stays; each line covered by
another one is removed. Windows are judged on the input, not on what is left.

Plan: windows are hashed to 128 bits where they are read and leave their text behind. Minima per
hash are taken before the shuffle, so a passage that every document shares costs a row a task. Hashes
found twice are joined back to the windows; that join's sides are what Spark can split if a hash is hot. The later
windows' positions meet the texts by document; merging covered positions is a set operation in the row.

Results for odd input: a null text has no lines, an empty one has one empty line; a document of fewer
than three lines loses nothing; a null id counts as the largest; rows with the same id and text are one
occurrence, so neither removes the other; an empty table gives no rows. Further columns are carried
along, but for those with the name of a result column, whatever its case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import field, flattened, row_of

LAST_ID = (1 << 63) - 1
#: A byte that is not ASCII white space.
WORD = r"[^ \t-\r]"


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, n_lines, n_removed and kept_text (null for a null text)."""
    return flattened(line_rows(docs), docs)


def line_rows(docs: DataFrame) -> DataFrame:
    """The same as (_row, _found), see common.row_of()."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_text_hash")]
    lines = docs.where("text is not null").select(*key, F.split("text", "\n", -1).alias("_lines"))
    three = lambda i: [F.get("_lines", i + k) for k in range(3)]
    windows = (
        lines.where(F.size("_lines") >= 3)
        .select("_id", "_text_hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_lines") - 3), lambda i: F.when(F.concat(*three(i)).rlike(WORD), F.struct(F.xxhash64(*three(i)).alias("a"), F.xxhash64(*three(i)[::-1], F.lit(1)).alias("b"))))).alias("_at", "_window"))
        .where("_window is not null")
        .select("_id", "_text_hash", "_at", F.col("_window.a").alias("_a"), F.col("_window.b").alias("_b"))
    )
    place = F.struct("_id", "_at", "_text_hash")
    repeated = windows.groupBy("_a", "_b").agg(F.min(place).alias("_least"), F.max(place).alias("_most")).where("_least <> _most").select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), "_least")
    later = windows.join(repeated, (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d"))).where(place != F.col("_least"))
    starts = later.groupBy("_id", "_text_hash").agg(F.collect_set("_at").alias("_starts")).select(F.col("_id").alias("_of"), F.col("_text_hash").alias("_of_hash"), "_starts")
    rows = docs.select(row_of(docs), *key)
    met = rows.join(starts, (F.col("_id") == F.col("_of")) & (F.col("_text_hash") == F.col("_of_hash")), "left")
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.array(p, p + 1, p + 2))))
    text = field(docs, "text")
    split = met.select("_row", F.split(text, "\n", -1).alias("_lines"), covered.alias("_covered"))
    left = split.select("_row", "_lines", "_covered", F.when(F.col("_covered").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_covered")).alias("_left"))
    kept = F.when(F.col("_covered").isNull(), text).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    return left.select(
        "_row",
        F.struct(
            F.when(text.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered")).cast("long").alias("n_removed"),
            kept.alias("kept_text"),
        ).alias("_found"),
    )


#: The same in SQL, with the kept text's digest in its place.
LINES_SQL = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts),
windows AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM numbered WHERE i + 2 <= len(ls) AND regexp_matches(ls[i] || ls[i + 1] || ls[i + 2], '[^ \\t-\\r]')),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM windows),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
kept AS (
  SELECT n.doc_id, count(covered.i) AS n_removed, string_agg(CASE WHEN covered.i IS NULL THEN n.ls[n.i] END, chr(10) ORDER BY n.i) AS text, count(*) AS n_lines
  FROM numbered n LEFT JOIN covered ON n.doc_id = covered.doc_id AND n.i = covered.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
