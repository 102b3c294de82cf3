"""Small fixtures and plain versions of what the operators compute."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, schema=DOCS):
    """Documents of ``{id: text}`` or ``[(id, text)]``."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], schema)


def clashing(df):
    """More columns, with names that the operators might use themselves."""
    from pyspark.sql import functions as F

    extra = ("id", "a", "b", "n", "score", "rows", "cluster", "component", "label", "uid", "spans", "_kept", "_bad", "_source", "raked")
    return df.select("*", *[F.lit(1).alias(c) for c in extra])


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked_components(texts, size, percent=80):
    """Smallest id reachable of each id, by comparing every pair."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}
