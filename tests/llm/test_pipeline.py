from collections import Counter

import corpus_pipeline
from tessera.llm import stages

from .fixtures import rows, table
from .test_operators import brute_lines, brute_print, brute_words, groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(spark, data=None):
    return table(spark, data).select(*COLUMNS)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]


def test_stages_keep_columns_and_take_effect(spark):
    docs, data = plain(spark), [r[:5] for r in rows()]
    out = stages.language_stage(spark, docs, "")
    assert out.columns == COLUMNS
    kept = {r.doc_id for r in out.collect()}
    assert kept == {r[0] for r in data if any(c.isalpha() for c in r[1] or "")}

    out = stages.line_stage(spark, docs, "")
    assert out.columns == COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((a, t) for a, _, _, t in brute_lines(data))
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)

    out = stages.near_dedup_stage(spark, docs, "")
    root = groups([brute_print(r[1]) for r in data])
    least = {k: min(r[0] for r, x in zip(data, root) if x == k) for k in root}
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(least.values())

    out = stages.substring_stage(spark, docs, "")
    removed = {d: n for d, _, n, _ in brute_words(data)}
    texts = {r[0]: r[1] for r in data}
    assert out.columns == COLUMNS and len(out.collect()) == len(data)
    for r in out.collect():
        if removed[r.doc_id]:
            assert len(r.text.split()) == len(texts[r.doc_id].encode().split()) - removed[r.doc_id]
        else:
            assert r.text == texts[r.doc_id]


def test_near_dedup_stage_decides_by_row(spark):
    data = [r[:5] for r in rows()]
    long = [r for r in data if len(r[1] or "") > 200][:6]
    other = lambda i, r: (i, *r[1:])
    # Repeated rows, copies without an id (one of them with no row that has one), and an id that a copy and a clean text share.
    few = [long[0], long[0], other(None, long[0]), other(None, long[1]), other(None, long[1]), other(-7, long[2]), other(long[5][0], long[2]), long[3], long[5]]
    for some in (few, data + few):
        root = groups([brute_print(r[1]) for r in some])
        least = {k: min(((r[0] is None, r[0] or 0) for r, x in zip(some, root) if x == k)) for k in root}
        out = stages.near_dedup_stage(spark, spark.createDataFrame(some, plain(spark).schema), "").collect()
        assert Counter((r.doc_id is None, r.doc_id or 0) for r in out) == Counter(least.values())
        assert sorted(groups([brute_print(r.text) for r in out])) == list(range(len(least)))
    assert long[5][1] in {r.text for r in out}


def test_language_stage_keeps_texts_of_an_unlabelled_corpus(spark):
    data = [(*r[:2], None, *r[3:]) for r in rows()]
    kept = {r.doc_id for r in stages.language_stage(spark, plain(spark, data), "").collect()}
    assert kept == {r[0] for r in data if any(c.isalpha() for c in r[1] or "")}


def test_empty_table_passes_through(spark):
    docs = plain(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_run_equals_stages(spark, tmp_path):
    plain(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, out.select(*key).collect())) == Counter(map(tuple, docs.select(*key).collect()))
    assert docs.count() > 50
