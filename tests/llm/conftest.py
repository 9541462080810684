import random

import pytest

#: Names that operators use inside, and of columns that they add.
EXTRA = ["size", "key", "h", "rid", "fp", "w", "n", "score", "shard", "kept", "_text", "_text_in", "_ids", "_decoded", "c0", "t", "s", "stays", "cand", "first", "h1", "k1", "topic_", "weight", "_weight", "_s", "rng", "part", "host", "ids", "held_out"]


def make(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with clashing extra columns; ``rows`` has (id, text, lang, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    data = [(i, t, la, s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, la, s in rows]
    return spark.createDataFrame(data, schema)


def texts(seed=1, n=60):
    """Prose with copies, near copies, shared passages and lines, odd texts and nulls."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "Tion", "straße", "où", "élan", "日本", "a,b", "x."] + ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    block = "\n".join(" ".join(r.choice(vocabulary) for _ in range(6)) for _ in range(8))
    rows, whole = [], []
    for i in range(n):
        t = "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 9)))
        if i % 7 == 0 and whole:
            t = r.choice(whole)
        if i % 9 == 0:
            t = f"{t} {passage} {t[:20]}"
        if i % 8 == 0:
            t = f"{t}\n{block}\nend"
        if i % 11 == 0 and whole:
            t = r.choice(whole) + " more"
        whole.append(t)
        rows.append((i, t, "de" if "ß" in t else "fr", f"src{i % 3 if i % 2 else 0}"))
    odd = [None, "", " ", "\n\n", "a", "A b", "...", "word " * 400, "ab " * 50 + "\n" + "ab " * 50, "<|endoftext|>", "x" * 5000, "p q\n" * 40]
    rows += [(n + k, t, None if k % 2 else "en", None if k % 3 else "odd") for k, t in enumerate(odd)]
    rows += [(None, "no id here", "en", "odd"), (None, None, None, None), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
