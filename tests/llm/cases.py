"""Small tables with nulls, blanks, ties, repeated rows, a long text and columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, id string, target double"


def rows(seed: int = 1, n: int = 120, words: int = 60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.15 and out:
            text = rnd.choice(out)[1]
        elif kind < 0.3 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, words)))
        out.append((i, text, "en", rnd.choice(["a", "b", "B", "ü", None]) if rnd.random() < 0.6 else "a", len(text), 7, "r", None, None))
    extra = [None, "", "   \t\n ", "one", "Two    words\x0bhere", "x" * 3000, " ".join(rnd.choice(vocab) for _ in range(6000)),
             "<|endoftext|> inside's 'll <|endoftext|>", "\U0001f642 漢字 ẞ\x00z"]
    out += [(n + k, t, None, None, None, None, None, "x", 1.0) for k, t in enumerate(extra)]
    return out


def table(spark, **how):
    return spark.createDataFrame(rows(**how), SCHEMA)


def ragged(spark, **how):
    """As `table`, with rows that repeat and rows without an id."""
    own = rows(**how)
    return spark.createDataFrame([*own, *own[:7], *[(None, *r[1:]) for r in own[:5]], (None, None, *([None] * 7))], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
