"""No name of a user's column, null id or repeated row may disturb a stage or operator."""

from collections import Counter

import pytest

from tessera.llm import language, lines, quality, stages, substring, suffix

from .fixtures import odd_ids, rows

NAMES = ["score", "n_words", "N_Removed", "n_lines", "_text", "_gone", "_text_of", "_new_text", "_row", "_found", "_id", "_digest", "_root", "_block", "kept_text", "KEPT", "held_out", "a.b", "sequence_id"]


def clashing(spark):
    """Each row's further columns hold its number, so that values can be told."""
    data = odd_ids([r[:5] for r in rows()])
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(*r, *[f"{c} {k}" for c in NAMES]) for k, r in enumerate(data)], schema)


def values(df, columns):
    return Counter(tuple(r[df.columns.index(c)] for c in columns) for r in df.collect())


@pytest.mark.parametrize("stage", [stages.language_stage, stages.line_stage, stages.near_dedup_stage, stages.substring_stage])
def test_stages_keep_all_columns(spark, stage):
    docs = clashing(spark)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    own = values(docs, ["doc_id", *NAMES])
    kept = values(out, ["doc_id", *NAMES])
    assert kept <= own and (kept == own or stage in (stages.language_stage, stages.near_dedup_stage))
    assert all(r.n_chars == len(r.text) for r in out.select("text", "n_chars").collect() if r.text is not None and stage in (stages.line_stage, stages.substring_stage))
    packed = stages.packing_stage(spark, out, "")
    assert packed.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and packed.count() > 0


def test_substring_stage_keeps_lines(spark):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows()], "doc_id long, text string")
    before = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    shorter = 0
    for r in stages.substring_stage(spark, docs, "").collect():
        if r.text is None or not found[r.doc_id].n_removed:
            assert r.text == before[r.doc_id]
            continue
        left = iter(before[r.doc_id].encode())
        assert all(b in left for b in r.text.encode())  # cut out of the text, nothing new
        shorter += "\n" in r.text
    assert shorter > 3


@pytest.mark.parametrize(("operator", "results"), [(lines.dedup_lines, ["n_lines", "n_removed", "kept_text"]), (substring.dedup_substrings, substring.RESULT), (suffix.dedup_bytes, suffix.RESULT), (quality.quality_rules, [*quality.MEASURES, "base_failed", "failed_rule", "kept"])])
def test_operators_carry_other_columns(spark, operator, results):
    docs = clashing(spark)
    out = operator(docs)
    low = [r.lower() for r in results]
    others = [c for c in docs.columns if c.lower() not in low]
    assert [c for c in out.columns if c.lower() not in low] == others and set(results) <= set(out.columns)
    assert values(out, others) == values(docs, others)


def test_language_carries_what_is_asked_for(spark):
    docs = clashing(spark)
    out = language.identify(docs, carried=["doc_id", "_text_of", "a.b", "SCORE"])
    assert out.columns == ["doc_id", "_text_of", "a.b", *language.RESULT]
    assert values(out, ["doc_id", "_text_of", "a.b"]) == values(docs, ["doc_id", "_text_of", "a.b"])
