import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from tessera.llm import cover_tree, language, lexicon

from .fixtures import odd_ids, rows, table

TOKENS = pytest.importorskip("public_tokenizers")
FILE = TOKENS.path("word_bpe_49k.json")


def test_automaton_numbers_words_in_order():
    words = sorted({w.encode() for r in rows() if r[1] for w in r[1].split()} | {b"a", b"ab", b"abc", b"b", b"bc", b"\xff"})
    automaton = lexicon.Automaton.compiled(words)
    assert automaton.numbers(words[::-1]).tolist() == list(range(len(words)))[::-1]
    assert automaton.numbers([b"", b"abcd", b"zz", b"a", b""]).tolist() == [-1, -1, -1, words.index(b"a"), -1]
    assert len(lexicon.Automaton.compiled([b"bats", b"cats", b"rats"]).final) == 5
    assert lexicon.Automaton.compiled([]).numbers([b"a", b""]).tolist() == [-1, -1]


def test_lexicon_file(tmp_path):
    entries = {b"one": ("1", "one</w>"), b"two": ("2 3", "t wo</w>"), b"twos": ("2 4", "t w\u0120os</w>")}
    lexicon.Lexicon.compiled(entries).save(str(tmp_path / "x"))
    back = lexicon.Lexicon.mapped(str(tmp_path / "x"))
    assert dict(zip(entries, back.outputs_of(list(entries)), strict=True)) == entries and list(back.outputs_of([b"tw", b""])) == [None, None]
    lexicon.Lexicon.compiled({}).save(str(tmp_path / "y"))
    assert list(lexicon.Lexicon.mapped(str(tmp_path / "y")).outputs_of([b"tw"])) == [None]


@pytest.mark.parametrize("max_words", [1, 10_000])
def test_bpe(spark, max_words):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE)
    data = odd_ids(rows())
    out = lexicon.code(table(spark, data), FILE, with_ids=True, max_words=max_words).collect()
    want = []
    for r in data:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in out) == Counter(want)
    assert lexicon.code(table(spark, []), FILE).count() == 0


SCRIPTS = [
    "It\u2019s \u201ccurly\u201d \u2014 a dash\u2026 and an en\u2013dash", "\u041f\u0440\u0438\u0432\u0435\u0442, \u041c\u0418\u0420! \u0401\u043b\u043a\u0430 \u0438\u0306", "\u039f\u0394\u039f\u03a3 \u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2 \u03b1\u0301",
    "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8\u3001\u304b\u3099 \uff21\uff22\uff23", "\uc548\ub155 \u1112\u1161\u11ab", "\U0001f600\U0001f44d\U0001f3fd family", "\u0130stanbul cafe\u0301 \u00bd \u0663 \u2160 a\u00a0b\u3000c\u200bd", "\u05e9\u05dc\u05d5\u05dd \u0645\u0631\u062d\u0628\u0627", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35", "\U00020000 \u00df\ufb01", "late \u088f \ua7ce \U0001246f \U000323b0 \u208f",
]


def test_texts_of_all_scripts(spark):
    from tokenizers import Tokenizer

    from tessera.llm import packing

    texts = SCRIPTS + [a + b for a in SCRIPTS for b in SCRIPTS[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(FILE)
    for r in lexicon.code(docs, FILE, with_ids=True, max_words=20).collect():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == whole.decode(ids, skip_special_tokens=False), texts[r.doc_id]
    whole = Tokenizer.from_file(TOKENS.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.pack(docs, TOKENS.path("byte_bpe_50k.json"), TOKENS.path("byte_bpe_50k.tiktoken"), with_ids=True).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert all(got[k] == whole.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts))


def test_most_scripts_go_by_word():
    from tessera.llm.characters import agreed

    assert [agreed(t) for t in SCRIPTS] == [True] * (len(SCRIPTS) - 1) + [False]
    merger = lexicon.Merger(FILE)
    ids = {w: merger.merged(w) for t in SCRIPTS[:-1] for w in lexicon.cut(t)}
    coder = lexicon.Coder(merger, lexicon.Lexicon.compiled({w.encode(): i for w, i in ids.items()}))
    list(coder.coded(SCRIPTS[:-1]))
    assert not coder.merged  # all from the transducer


def test_tables_agree_on_characters():
    """Cuts and lower case of every agreed character, in context, as the library's."""
    from tessera.llm import packing
    from tessera.llm.characters import agreed, lowered

    back = {c: i for i, c in enumerate(lexicon.byte_alphabet())}
    text = "\n\n".join(f"a{c}b 1{c}2 .{c}" for c in map(chr, [*range(0x80, 0xD800, 5), *range(0xE000, 0x10000, 7), *range(0x1F000, 0x1FB00, 3)]) if agreed(c))
    for name, cut, prepared in (("byte_bpe_50k.json", regex.compile(packing.WIDE_CUT).findall, text), ("word_bpe_49k.json", lexicon.WIDE_CUT.findall, lowered(text))):
        whole = lexicon.Tokenizer.from_file(TOKENS.path(name))
        pieces = whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(text) if whole.normalizer else text)
        assert [bytes(back[c] for c in p).decode() for p, _ in pieces] == cut(prepared)


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)


def test_language_id_odd_rows(spark):
    data = odd_ids(rows())
    out = language.identify(table(spark, data)).collect()
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in data if r[0] is not None}
    assert len(out) == len(data)
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in out if r.doc_id is not None)
    assert language.identify(table(spark, [])).count() == 0
    unlabelled = table(spark).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_labels_are_no_input(spark):
    docs = table(spark)
    model = language.fit(docs)
    a = language.identify(docs, model=model).orderBy("doc_id").collect()
    b = language.identify(docs.withColumn("lang", language.F.lit("zz")).withColumn("source", language.F.lit("q")), model=model).orderBy("doc_id").collect()
    assert a == b


def vectors(seed=2, n=160, size=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, size))
    out = []
    for k in range(n):
        v = centres[k % 6] + draw.normal(size=size) * draw.choice([0.02, 0.05, 0.08, 1.0])
        out.append((k, [float(np.float32(x)) for x in v], k % 3))
    out += [(n + k, out[k][1], out[k][2]) for k in range(10)] + [(n + 20 + k, out[0][1], 0) for k in range(30)]
    out += [(900, None, 1), (901, [], 1), (902, [0.0] * size, 1), (903, [float("nan")] * size, 1), (904, [1.0, None] + [0.0] * (size - 2), 1), (905, [float("inf")] * size, 1), (906, out[0][1], None), (907, out[0][1][:4], 0), (None, out[0][1], 0)]
    return out


def brute_links(data, cosine):
    fine = [k for k, (i, v, lab) in enumerate(data) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {k: set() for k in range(len(data))}
    for a in fine:
        for b in fine:
            x, y = np.array(data[a][1], float), np.array(data[b][1], float)
            if a != b and data[a][2] == data[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                linked[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(data):
        seen, todo = {k}, [k]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        out.append((i, len(linked[k]), least, i is None or i == least))
    return Counter(out)


@pytest.mark.parametrize(("cell_rows", "cosine"), [(4096, 0.98), (12, 0.98), (12, 0.8)])
def test_embedding_dedup(spark, cell_rows, cosine):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    out = cover_tree.dedup_embeddings(df, cosine, cell_rows).collect()
    assert Counter(tuple(r) for r in out) == brute_links(data, cosine)
    assert cover_tree.dedup_embeddings(df.limit(0)).count() == 0


def test_embedding_sql_on_vectors_with_links(spark):
    import duckdb

    data = [r for r in vectors() if r[0] is not None]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in data])
    want = c.execute(cover_tree.EMBEDDINGS_SQL).fetchall()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in cover_tree.dedup_embeddings(df).collect()) == Counter(want) and sum(r[1] for r in want) > 100


@pytest.mark.parametrize("most_pivots", [1, 3, 500])
def test_embedding_dedup_splits_cells(spark, most_pivots):
    """Cells of more than cell_rows points, and more cells than a label had once at most."""
    data = [(k, v, 0) for k, v, label in vectors(n=700) if label is not None]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    tasks = cover_tree.pair_tasks(df.where("vec_id < 700").selectExpr("label", "size(embedding) as size", "embedding as vector", "vec_id as point", "1L as weight"), 0.98, 8, most_pivots)
    sizes = tasks.groupBy("first", "last", "second").count().collect()
    assert max(r["count"] for r in sizes) < 40 and (most_pivots < 500 or len({r["first"] for r in sizes}) > 64)
    out = cover_tree.dedup_embeddings(df, 0.98, 8, most_pivots).collect()
    assert Counter(tuple(r) for r in out) == brute_links(data, 0.98)


def test_near_copies_are_linked_as_a_whole():
    draw = np.random.default_rng(6)
    tight = cover_tree.unit(np.concatenate([[1.0, 0, 0, 0] + draw.normal(size=(500, 4)) * 0.01, draw.normal(size=(200, 4))]))
    tree, weights = cover_tree.CoverTree(tight), draw.integers(1, 4, 700)
    told = cover_tree.linked_points(tree, tree, 0.98, weights, weights)
    linked = tight @ tight.T >= 0.98
    np.fill_diagonal(linked, False)
    assert (told.sums(0) + told.sums(1)).tolist() == (linked @ weights).tolist()
    assert sum(len(p) for p, _ in told.points) + sum(len(u) for u, _ in told.nodes) < 0.1 * linked.sum() / 2


@pytest.mark.parametrize("cell_rows", [10, 40])
def test_embedding_dedup_counts_a_link_once_across_uneven_cells(spark, cell_rows):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 8))
    data = [(k, [float(np.float32(x)) for x in centres[k % 6] + draw.normal(size=8) * (0.02, 0.02, 0.02, 0.05, 0.5, 1.5)[k % 6]], 0) for k in range(240)]
    out = cover_tree.dedup_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), 0.98, cell_rows).collect()
    assert Counter(tuple(r) for r in out) == brute_links(data, 0.98)


def test_pair_task_with_points_of_one_cell_has_no_links():
    task = {"point": [1, 2, 3], "weight": [1, 1, 1], "vector": [[1.0, 0.0]] * 3, "first": [0] * 3}
    for second in (False, True):
        assert cover_tree.compare_cells(pa.table(task | {"last": [1] * 3, "second": [second] * 3}), 0.98).num_rows == 0
    assert cover_tree.compare_cells(pa.table(task | {"last": [0] * 3, "second": [False] * 3}), 0.98).column("links").to_pylist() == [2, 2, 2]


def test_cover_tree_levels():
    draw = np.random.default_rng(1)
    points = cover_tree.unit(draw.normal(size=(300, 6)))
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(300))
    for node, children in enumerate(tree.children):
        inside = set(tree.members(node).tolist())
        assert tree.centre[node] in inside
        assert tree.distances(tree.centre[node], tree.members(node)).max() <= tree.radius[node] + 1e-7
        if children:
            assert sorted(x for c in children for x in tree.members(c).tolist()) == sorted(inside)
            assert tree.centre[node] in {tree.centre[c] for c in children}


def plain_language(data, train):
    """The backoff in plain Python, word by word: (prediction, score) of each text."""
    import math

    langs = sorted({lang for _, lang in train})
    words_of = lambda t: ["".join(g) for k, g in itertools.groupby(t.lower(), str.isalpha) if k]
    words, parts = Counter(), Counter()
    for text, lang in train:
        for w in words_of(text):
            words[w, lang] += 1
            for n in (1, 2, 3, 4):
                parts.update((n, f"^{w}$"[k : k + n], lang) for k in range(len(w) + 3 - n) if len(w) + 2 >= n)
    vocabulary, grams = {w for w, _ in words}, {(n, g) for n, g, _ in parts}
    total = {x: sum(c for (_, lang), c in words.items() if lang == x) + 0.5 * len(vocabulary) for x in langs}
    whole = {(n, x): sum(c for (m, _, lang), c in parts.items() if (m, lang) == (n, x)) + 0.5 * sum(m == n for m, _ in grams) for n in (1, 2, 3, 4) for x in langs}

    def scored(w, x):
        if w in vocabulary:
            return math.log((words[w, x] + 0.5) / total[x])
        for n in (4, 3, 2, 1):
            found = [g for g in (f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)) if (n, g) in grams]
            if found:
                return sum(math.log((parts[n, g, x] + 0.5) / whole[n, x]) for g in found) / len(found)
        return 0.0

    for text in data:
        sums = [sum(scored(w, x) for w in words_of(text or "")) for x in langs]
        if not words_of(text or ""):
            yield "und", 0.0
        else:
            best = max(range(len(langs)), key=lambda k: (sums[k], -k))
            yield langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_language_id_by_plain_backoff(spark):
    data = rows() + [(700, "x" * 300 + " zzzz qqqzz the xyz", None, "s", 1, 7, "x", "y", True)]
    train = [(r[1], r[2]) for r in data if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table(spark, data)).collect()}
    for r, (lang, score) in zip(data, plain_language([r[1] for r in data], train), strict=True):
        assert got[r[0]][1] == pytest.approx(score, abs=1e-6) and (got[r[0]][0] == lang or abs(score - 0.5) < 1e-6), r[:2]
