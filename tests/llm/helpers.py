import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    None, "", " ", "\n", "a", "Two words", "  lead and trail  ", "tab\tand\r\nline\x0bx\x0cy", "double  space", "a\n\nb\n\n\nc\n", "end newline\n", "x <|endoftext|> y", "<|endoftext|>",
    "don't we're I'll it's 'quoted'", "números 12345 67,89 ½ Ⅷ", "漢字かな交じり文。テスト", "emoji 🙂🙃 family 👨‍👩‍👧", "nbsp\xa0here em　wide", " sep\x85nel\x1cfs", "Ünïcödé ÀÉ İı ſK K",
    "!!!??? ... --- ___ === ~~~", "a" * 3000, "word " * 2000, "мир и труд", "\x00nul\x01", "a \rb c", "zero​width",
]


def some_docs(n=200, seed=1, sources=5):
    """Rows of documents: invented words, exact and near copies, and odd texts."""
    rng = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    texts = list(ODD)
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.1 and len(texts) > 40:
            texts.append(rng.choice(texts))
        elif kind < 0.25 and len(texts) > 40:
            w = (rng.choice(texts) or "x").split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 8))))
    names = [None, *[f"src{i}" for i in range(sources - 1)]]
    return [(3 * i + 1, t, "en", names[0 if i % 3 == 0 else rng.randrange(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def odd_rows():
    """Nulls in every column, ties and repeated rows."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    return [*rows, (None, "no id here at all", None, None, None), (None, None, None, None, None), (5, "Two words", "en", "s", 1), (5, "Two words", "en", "s", 1), (5, "another text under one id", "en", None, 1)]
