import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import lines, packing, quality, sharding, simhash, substring, suffix

from .fixtures import SCHEMA, odd_ids, rows, table

TOKENS = pytest.importorskip("public_tokenizers")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding_balances_and_keeps_all(spark, shards):
    data = odd_ids(rows())
    out = sharding.shard_documents(table(spark, data), shards).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_moves_little_and_stands_copies(spark):
    data = rows(n=400)
    place = lambda n: {r.doc_id: r.shard for r in sharding.shard_documents(table(spark, data), n).collect()}
    a, b = place(8), place(9)
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)
    many = [data[0]] * 300 + data[:50]
    out = sharding.shard_documents(table(spark, many).repartition(3), 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in out) == [87, 87, 88, 88]
    assert sharding.shard_documents(table(spark, []), 4).count() == 0


def test_walk_goes_on_clockwise():
    assert sharding.walk([0, 1, 2], [5, 1, 0], [2, 2, 2]) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]
    with pytest.raises(ValueError):
        sharding.walk([0], [2], [1])


# Substring dedup


def brute_words(data, window=13):
    docs = [(r[0], (r[1] or "").encode().split()) for r in data]
    first = {}
    for d, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if d is None else d)
    out = []
    for d, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (1 << 62 if d is None else d):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_substring_dedup(spark, block_bytes):
    data = odd_ids(rows())
    out = substring.dedup_substrings(table(spark, data), block_bytes=block_bytes)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == brute_words(data)
    assert {"lang", "source", "shard", "_id", "kept"} < set(out.columns)
    assert out.where("n_removed > 0").count() > 10


def test_difference_cover():
    for shift in range(substring.PERIOD):
        assert any((a - b) % substring.PERIOD == shift for a in substring.COVER for b in substring.COVER)


def test_substring_dedup_of_nothing(spark):
    assert substring.dedup_substrings(table(spark, [])).count() == 0
    assert substring.dedup_substrings(table(spark, [(1, None, *rows()[0][2:])])).first().n_words == 0


# Byte dedup


def brute_bytes(data, length):
    texts = [(r[1] or "").encode() for r in data]
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for r, t in zip(data, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((r[0], len(t), sum(gone), spans, sha(bytes(x for x, g in zip(t, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize(("block_bytes", "length"), [(700, 40), (1 << 20, 40), (3000, 200), (1 << 20, 200)])
def test_byte_dedup(spark, block_bytes, length):
    data = odd_ids(rows())
    out = suffix.dedup_bytes(table(spark, data), length, block_bytes)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == brute_bytes(data, length)
    assert {"lang", "shard", "_id"} < set(out.columns)


def test_byte_dedup_of_nothing(spark):
    assert suffix.dedup_bytes(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.dedup_bytes(table(spark, []), 201)


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    data = odd_ids(rows())
    whole = Tokenizer.from_file(TOKENS.path("byte_bpe_50k.json"))
    files = TOKENS.path("byte_bpe_50k.json"), TOKENS.path("byte_bpe_50k.tiktoken")
    out = packing.pack(table(spark, data), *files, with_ids=True).collect()
    want = Counter((r[0], tuple(whole.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in data)
    pieces = defaultdict(list)
    for r in out:
        assert r.length & r.length - 1 == 0 and r.length <= 1024 and r.length == len(r.ids) and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.sequence_id >> 58 == r.length.bit_length() - 1
        pieces[r.doc_id].append(r)
    assert len({r.sequence_id for r in out}) == len(out)
    once = [k for k, n in Counter(r[0] for r in data).items() if n == 1 and k is not None]
    for d in once:
        ids = [i for r in sorted(pieces[d], key=lambda r: r.start) for i in r.ids]
        assert want[d, tuple(ids)] == 1
    assert sum(r.length for r in out) == sum(len(k[1]) * n for k, n in want.items())
    assert packing.pack(table(spark, []), *files).count() == 0


def test_binary_pieces():
    assert list(packing.binary_pieces(2053)) == [(0, 1024), (1024, 1024), (2048, 4), (2052, 1)]
    assert list(packing.binary_pieces(1)) == [(0, 1)]


# Line dedup


def brute_lines(data):
    docs = sorted({(1 << 62 if r[0] is None else r[0], r[1]) for r in data if r[1] is not None})
    first = {}
    for d, t in docs:
        ls = t.split("\n")
        for k in range(len(ls) - 2):
            if "".join(ls[k : k + 3]).strip(" \t\n\x0b\x0c\r"):
                first.setdefault(tuple(ls[k : k + 3]), []).append((d, k, t))
    out = []
    for r in data:
        if r[1] is None:
            out.append((r[0], 0, 0, None))
            continue
        d, ls = (1 << 62 if r[0] is None else r[0]), r[1].split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            places = first.get(tuple(ls[k : k + 3]))
            if places and min(p[:2] for p in places) != (d, k):
                gone.update(range(k, k + 3))
        out.append((r[0], len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return Counter(out)


def test_line_dedup(spark):
    data = rows()
    data += [data[3], data[3]]
    out = lines.dedup_lines(table(spark, data))
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in out.collect()) == brute_lines(data)
    assert set(SCHEMA.split(", ")) and {"n_words", "_id", "shard"} < set(out.columns)
    assert out.where("n_removed > 0").count() > 5
    assert lines.dedup_lines(table(spark, [])).count() == 0
    assert lines.dedup_lines(table(spark, odd_ids(rows()))).count() == len(odd_ids(rows()))


# Quality rules


def test_quality_rules(spark):
    data = odd_ids(rows())
    out = quality.quality_rules(table(spark, data))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = []
    for r in data:
        t = r[1] or ""
        w = [x.decode() for x in t.encode().split()]
        ls = [x for x in t.split("\n") if x.encode().split()]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        n = len(again)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), n, len(w) < 50 or 100 * n > 50 * len(w)))
    assert got == Counter(want)
    assert all(r.kept == (r.failed_rule is None) for r in out.collect())
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    docs = table(spark)
    kept = [Counter((r.i, r.kept) for r in quality.judged(docs, order, quality.RULES).select(quality.F.col("_row.c0").alias("i"), "_found.kept").collect()) for order in (list(quality.RULES), list(quality.RULES)[::-1])]
    assert kept[0] == kept[1]
    order = quality.by_rejection_per_cost(quality.measured(docs), {"never": "false", "always": "true"})
    assert order == ["always", "never"]


def test_costly_rules_run_last_and_in_a_stable_order(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 500, 4000)) for _ in range(60)]
    sample = quality.settled(quality.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).coalesce(1))
    costly = "aggregate(split(_text, ' '), 0L, (s, w) -> s + length(regexp_replace(w, '[0-9]', ''))) > 100000"
    rules = {"costly": costly, "cheap": "n_words > 1000000", "symbols": quality.RULES["symbols"]}
    orders = [quality.by_rejection_per_cost(sample, rules) for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] == ["cheap", "symbols", "costly"]
    assert quality.cost_step(-1) == quality.cost_step(quality.FLOOR) == 1 and quality.cost_step(3 * quality.FLOOR) == quality.STEP


def test_later_rules_do_not_run(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, "word " * 30 + "x y z " * 4 + " ".join(f"a{k}" for k in range(200)))], "doc_id long, text string")
    rules = {"first": "n_words > 60", "last": "raise_error(_text) is null"}
    got = [r.failed_rule for r in quality.judged(docs, ["first", "last"], rules).select("_found.failed_rule").collect()]
    assert got == ["base", "first"]
    with pytest.raises(Exception, match="few|word"):
        quality.judged(docs, ["last", "first"], rules).select("_found.failed_rule").collect()


@pytest.mark.parametrize(("rule", "text"), [("bullets", "\n".join(f"- item{k} is{k} listed{k} here" for k in range(15))), ("ellipses", "\n".join(f"more{k} of line{k} follows{k} here..." for k in range(15))), ("few_words", " ".join("abcdefghijklmn"[j] + "x" for k in range(9) for j in (k, k + 3, k + 1, k + 5, k + 2, k + 4))), ("lettered_words", " ".join(f"{k}" for k in range(60)) + " averylongwordofletters" * 8), ("letters", " ".join(f"a{k}0000" for k in range(60)))])
def test_rules_reject_what_they_are_for(spark, rule, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.judged(docs, [rule], quality.RULES).select("_found.failed_rule").first()[0] == rule


# SimHash


def brute_print(text):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in s.encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(prints, radius=3):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(prints))]


def test_simhash(spark):
    data = odd_ids(rows())
    out = simhash.dedup_simhash(table(spark, data)).collect()
    prints = [brute_print(r[1]) for r in data]
    root = groups(prints)
    least = defaultdict(list)
    for r, k in zip(data, root):
        if r[0] is not None:
            least[k].append(r[0])
    want = Counter((r[0], f"{p:016x}", min(least[k], default=None)) for r, p, k in zip(data, prints, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == want
    assert simhash.dedup_simhash(table(spark, [])).count() == 0


@pytest.mark.parametrize("split", [4, 2048])
def test_bit_sliced_links(monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = [b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, k).astype(np.uint64)) for b in base for k in (1, 1, 2, 3, 4, 6)]
    prints = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    forest = simhash.Forest(len(prints))
    for mask in simhash.key_masks(len(prints)):
        simhash.bucket_links(prints, prints & np.uint64(mask), forest, np.arange(len(prints)), ~mask & (1 << 64) - 1)
    assert forest.roots(np.arange(len(prints))).tolist() == groups([int(p) for p in prints])


def test_masks_cover_the_radius():
    draw = np.random.default_rng(5)
    for n in (1000, 1 << 24, 1 << 30, 1 << 40):
        masks = simhash.key_masks(n)
        for _ in range(300):
            bits = sum({1 << int(b) for b in draw.integers(0, 64, 3)})
            assert any(not bits & m for m in masks)


def test_components(spark):
    from tessera.llm.components import connected_components

    edges = [(k, k + 1) for k in range(1, 40)] + [(50, 50), (60, 61), (61, 60), (70, 71), (70, 72), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {60: 60, 61: 60, 70: 70, 71: 70, 72: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_chains_hubs_and_random_graphs(spark, monkeypatch):
    from tessera.llm import components

    rounds = []
    monkeypatch.setattr(components, "large_stars", lambda e, plain=components.large_stars: rounds.append(1) or plain(e))
    draw = np.random.default_rng(8)
    names = draw.permutation(900)
    chain = [(int(names[k]), int(names[k + 1])) for k in range(399)]
    hub = [(int(names[500]), int(x)) for x in names[501:600]]
    loose = [(int(x), int(y)) for x, y in draw.choice(names[600:], (150, 2))]
    up = {int(n): int(n) for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in chain + hub + loose:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain + hub + loose, "a long, b long")).collect()}
    assert got == {n: root(n) for e in chain + hub + loose for n in e if any(n in f and f[0] != f[1] for f in chain + hub + loose)}
    assert len(rounds) < 12


def doubled(levels):
    """Two texts of 2^levels letters, each the other's complement; sums of powers modulo 2^64 cannot tell them apart."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_structured_texts_are_told_apart(spark):
    a, b = doubled(10)
    head = " ".join(f"w{k}" for k in range(12))
    few = lambda texts: spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    data = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, " ".join(b)), (4, " ".join(a))]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(few([t for _, t in data])).collect())
    assert got == brute_words(data)
    a, b = doubled(12)
    data = [(k, t) for k, t in enumerate([a, b, a[:300] + "x" + b[:700], b[5:] + a[:333], "y" * 999], 1)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup_bytes(few([t for _, t in data])).collect())
    assert got == brute_bytes(data, 200)


@pytest.mark.parametrize(("operator", "limit"), [(substring.dedup_substrings, 3 << 20), (suffix.dedup_bytes, 2 << 20)])
def test_repeated_rows_and_long_texts_are_spread(spark, operator, limit):
    from tessera.llm.packed import blocks

    rows_ = spark.createDataFrame([(1, "same row " * 20)] * 4000, "doc_id long, text string")
    sizes = [r["count"] for r in blocks(rows_, 50_000)[0].groupBy("_block").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 2 * min(sizes)
    draw = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in draw.integers(0, 1 << 40, limit // 10))
    data = [(1, long), (2, "start " + long[1000:200_000] + " end"), (3, long[:300])]
    out = Counter((r.doc_id, r.n_removed) for r in operator(spark.createDataFrame(data, "doc_id long, text string")).collect())
    brute = brute_words(data) if operator is substring.dedup_substrings else brute_bytes(data, 200)
    assert len(long) > limit and out == Counter((r[0], r[2]) for r in brute)


def test_removal_keeps_line_breaks():
    cut = lambda text, gone: substring.without(text, [k in gone for k in range(len(text.split()))])
    assert cut(b" a b\n  c d\ne f ", {2}) == b" a b\n  d\ne f "
    assert cut(b"a b\nc d", {1, 2}) == b"a d" and cut(b"a\nb c", {1}) == b"a\nc"
    assert cut(b"a b\nc", {1}) == b"a\nc" and cut(b"\ta b", {0}) == b"\tb" and cut(b"a b ", {0, 1}) == b""


def brute_ring(data, shards, nodes, factor):
    """Shard and slot of each row, by walking the ring with one row after another, arcs taking turns by distance."""
    at = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    points = sorted((at(f"node {k % shards} {k // shards}"), k % shards) for k in range(shards * nodes))
    bounds = [len(data) // shards + (s < len(data) % shards) for s in range(shards)] if factor == 1 else [-int(-len(data) * factor // shards)] * shards
    held, slots = defaultdict(list), [0] * shards
    for r in data:
        p = at(f"key {'null' if r[0] is None else r[0]}")
        held[next((k for k, (x, _) in enumerate(points) if x >= p), 0)].append(r)
    place = Counter()
    for step in range(len(points)):
        for arc in range(len(points)):
            shard = points[(arc + step) % len(points)][1]
            n = min(len(held[arc]), bounds[shard] - slots[shard])
            place[arc, shard] += n
            slots[shard] += n
            held[arc] = held[arc][n:]
    return place, points, at


@pytest.mark.parametrize("factor", [1, 1.25, 2])
def test_sharding_by_ring_walk(spark, factor):
    data = odd_ids(rows(n=200))
    out = sharding.shard_documents(table(spark, data), 5, virtual_nodes=8, load_factor=factor).collect()
    place, points, at = brute_ring(data, 5, 8, factor)
    arc = lambda i: next((k for k, (x, _) in enumerate(points) if x >= at(f"key {'null' if i is None else i}")), 0)
    assert Counter((arc(r.doc_id), r.shard) for r in out) == +place
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) <= -int(-len(data) * factor // 5)


def test_sharding_does_not_depend_on_partitions(spark):
    data = odd_ids(rows(n=400)) + [rows(n=400)[7]] * 40
    got = [Counter(map(tuple, sharding.shard_documents(table(spark, data).repartition(n), 8).collect())) for n in (2, 7, 50)]
    assert got[0] == got[1] == got[2]


def test_sharding_moves_less_than_twice_the_ideal(spark):
    ids = spark.range(4000).select(sharding.F.col("id").alias("doc_id"), sharding.F.lit("x").alias("text"))
    place = lambda n: {r.doc_id: r.shard for r in sharding.shard_documents(ids, n).collect()}
    a, b = place(8), place(9)
    assert sum(a[k] != b[k] for k in a) < 2 * len(a) / 9


def test_byte_dedup_as_plain_doubling(spark):
    from .plain_doubling import DOC, repeated_positions

    data = [(r[0], r[1]) for r in rows(n=12) if r[1]]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = defaultdict(set)
    for r in repeated_positions(docs, 40, lambda df, _: df.checkpoint()).collect():
        found[r.pos // DOC].update(range(r.pos % DOC, r.pos % DOC + 40))
    got = {r.doc_id: r.n_removed for r in suffix.dedup_bytes(docs, 40, 3000).collect()}
    assert got == {i: len(found[i]) for i, _ in data} and sum(got.values()) > 500
