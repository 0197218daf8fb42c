"""Small documents with hot groups, near copies, shared passages and odd rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randint(0, 4000)}" for _ in range(n))


def documents(spark, rows, ddl=DOCS):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)))[:5] for r in rows], ddl)


def corpus(seed=5):
    """Rows of (id, text): unique texts, exact copies, near copies in a dense group, short and empty texts."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(30, 120))) for i in range(60)]
    base = words(rng, 100).split()
    for i in range(60, 160):  # a dense group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = f"edit{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, rows[3][1]) for i in range(160, 220)]  # exact copies
    rows += [(i, rows[4][1].upper()) for i in range(220, 223)]
    rows += [(300, "one two"), (301, "One  two"), (302, ""), (303, None), (304, "   "), (None, rows[5][1]), (305, rows[7][1] + " tail")]
    return rows
