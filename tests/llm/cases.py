"""Small tables that every operator must get through, and brute-force versions to hold results against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank as evening falls and small boats drift slowly home past the mill where bread is baked each day"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def rows():
    """Nulls in every column, empty and blank texts, a very long one, copies, near copies, a repeated row, odd white space."""
    near = BASE.split()
    texts = [BASE, BASE, " ".join([*near[:-1], "night"]), None, "", " \n\t ", "one", "one two", LONG, LONG + " end", "ÉÉ é x y z", "a a a a a a a a a a " * 8, BASE.upper(), "12 34 56", "日本語 の 文章 です"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return [*out, out[0], (None, BASE + " tail", "en", "s1", None), (None, None, None, None, None)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def repeated(texts, k=35):
    """Per text the words and which of them a repeated window covers."""
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((w, gone))
    return out


def shingles(text, k):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(pairs, k=3, num=90, den=100):
    """Smallest reachable id of each (id, text)."""
    sets = {i: shingles(t, k) for i, t in pairs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
