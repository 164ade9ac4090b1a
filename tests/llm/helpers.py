"""Documents with every awkward case, and plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = str.maketrans("0123456789", "abcdefghij")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    """n words that hardly repeat."""
    return " ".join(f"w{(seed * 7919 + k * 104729) % 1000003}" for k in range(n)).translate(LETTERS)


def awkward() -> list[tuple]:
    shared = prose(99, 70)
    base = prose(1, 200)
    near = base.split()
    near[50] = near[120] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (8, "one TWO"), (9, "a b c d e"),
        (10, f"{prose(2, 60)}\n{shared} {prose(3, 60)}"), (11, f"{prose(4, 40)} {shared}\n{prose(5, 40)}"), (12, shared), (12, shared), (None, base), (None, None),
        (13, prose(6, 20000)), (14, "x" * 20000), (15, "same line\nsame line\nsame line"), (16, prose(7, 30)), (17, prose(7, 30) + " more"),
    ]
    return [(i, t, "en", "s" if i != 9 else None, len(t or "")) for i, t in texts]


def frame(spark, rows=None, extra: bool = True):
    """The rows, with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    names = ["key", "class", "host", "n", "set_id", "spans", "numbers", "found", "value", "label", "u", "v"] if extra else []
    return df.select("*", *[F.lit("own").alias(c) for c in names])


def words(text) -> list[str]:
    return WORD.findall(text or "")


def shingles(text) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows) -> Counter:
    """(doc_id, n_shingles, component_id) of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)].append(d)
    return Counter((d, len(sets[i]), (min(ids[top(i)]) if ids[top(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def cut(rows, window=50) -> list[tuple]:
    """(doc_id, words, kept words) of each row."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), tuple(x for i, x in enumerate(w) if i not in gone)))
    return out
