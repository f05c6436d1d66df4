import random

import pytest


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): exact and near copies, shared lines, short, empty, null and very long texts, repeated rows."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(30, 120)) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(5)]                                      # exact copies
    for i in range(5, 15):                                                             # near copies: one word changed
        w = base[i].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w)))
    line = words(rng, 20)
    rows += [(300 + i, words(rng, 15) + "\n" + line + "\n" + words(rng, 9)) for i in range(6)]
    rows += [(310, line.upper()), (311, line + " more"), (312, line + "\n" + line)]
    rows += [(400, None), (401, ""), (402, "   \n \n"), (403, "one"), (404, "one"), (405, "Two words"), (406, "a b c d e")]
    rows += [(500, words(rng, 30_000, 500_000)), (None, base[20]), (None, None), (7, base[7]), (7, base[7])]
    rows += [(600, "!!! ??? ..."), (601, "été À Noël 123 你好 \U0001f600 <|endoftext|> it's\tfine  now")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, with further columns whose names clash with the operators' own."""
    rows = [(d, t, "en", "src0", None if t is None else len(t), 1, "x", 2.0, d) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id int, h string, score double, node long").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
