"""Small tables with all that operators must stand: nulls, empty and long texts, ties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_words string, _id string, kept boolean"
WORDS = "the a of tree house and green ran over Blue sky, ÄÖ über niño #tag $5 it's | x".split()


def rows(seed=1, n=60):
    """Documents that share passages, copies, near copies, and odd ones."""
    draw = random.Random(seed)
    word = lambda: draw.choice(WORDS) + (str(draw.randrange(300)) if draw.random() < 0.6 else "")
    line = lambda k: draw.choice([" ", "  ", "\t"]).join(word() for _ in range(k))
    passages = [line(draw.randrange(14, 60)) for _ in range(4)]
    blocks = ["\n".join(line(4) for _ in range(4)) for _ in range(2)]
    texts = []
    for _ in range(n):
        parts = [line(draw.randrange(1, 40)) for _ in range(draw.randrange(1, 4))]
        if draw.random() < 0.5:
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages + blocks))
        texts.append("\n".join(parts))
    texts += [texts[0]] * 5 + [texts[1] + " more"] + [texts[2][:-3]]
    texts += [None, None, "", "", " \n\t ", "one", "\n\n\n\n", "<|endoftext|> and <|startoftext|>", "日本語のテキスト", "é" * 500, "ab" * 400, line(3000), "a\nb\nc\na\nb\nc\na\nb\nc", "12 345 !?"]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    out = [(i, t, draw.choice(["en", "de", None]), "s", len(t or ""), 7, "x", "y", True) for i, t in zip(ids, texts)]
    return out


def table(spark, data=None, **options):
    return spark.createDataFrame(rows(**options) if data is None else data, SCHEMA)


def odd_ids(data):
    """Rows with null ids, and one row twice."""
    return data + [(None, data[0][1], *data[0][2:]), (None, "null id", *data[0][2:]), data[3], data[3]]
