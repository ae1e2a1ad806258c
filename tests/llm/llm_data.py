"""Small tables and brute-force versions for the tests of the numbered operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, rows):
    """Documents from (doc_id, text) or longer rows; an extra column stands for whatever a user's table has."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng: random.Random, n: int) -> str:
    syllables = ["ka", "ro", "mi", "ten", "sul", "ver", "do", "ping", "al", "esh", "or", "nu", "gri", "to", "ba"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def classes(nodes, links):
    """node -> smallest node that it reaches."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
