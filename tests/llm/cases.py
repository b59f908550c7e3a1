"""Awkward rows for all operators, and plain versions of what they compute."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(name, T.StringType()) for name in ("row", "size", "shard", "component_id", "Score", "n", "id", "unit", "_text", "a.b")]])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]


def awkward_rows():
    rng = random.Random(3)
    vocabulary = ["tha", "réon", "Und", "of", "ing", "the", "ständ", "ower", "éle", "qu", "re", "la"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long = make(60), make(9000)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", "  \t\n ", "one", "a b c d", base, base, base.upper(), " ".join(near), long, make(300), make(40), "12 34 !!", "\x00 odd \x00x",
             "ÉTÉ été Été", base + " tail", make(11), make(10), make(9)]
    rows = [(i, t, "fr" if i % 3 else None, "s" if i % 4 else None, None, *["x"] * 10) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base, None, None, None, *[None] * 10), (77, None, "de", "t", 1, *["x"] * 10)]


def classes(rows, size=5, percent=80):
    """(number of shingles, smallest linked id) of each row."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    holders = defaultdict(list)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        both = Counter(j for s in own for j in holders[s])
        for j, n in both.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for s in own:
            holders[s].append(i)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        known = [d for d in (doc, smallest.get(root(i))) if d is not None]
        smallest[root(i)] = min(known, default=None)
    return [(len(sets[i]), smallest[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def katz(rows, held, discounts, order=2, k=5):
    """(held, tokens, known, train tokens, base, score) per row, and the model as a function."""
    tokens = [words(t) + ["</s>"] for _, t in rows]
    counts = [None] + [Counter() for _ in range(order)]
    for t, out in zip(tokens, held):
        for n in range(1, order + 1) if not out else ():
            padded = ["<s>"] * (n - 1) + t
            counts[n].update(tuple(padded[i:i + n]) for i in range(len(t)))
    d = [None]
    for n in range(1, order + 1):
        seen = Counter(counts[n].values())
        d.append(discounts([0] + [seen[r] for r in range(1, k + 2)], k))
    of = lambda n, c: d[n][c] if c <= k else 1.0
    after = [None] + [defaultdict(dict) for _ in range(order)]
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            after[n][gram[:-1]][gram[-1]] = c
    total, types = sum(counts[1].values()), len(counts[1])
    left = sum((1 - of(1, c)) * c for c in counts[1].values())
    weights = {}

    def probability(n, history, word):
        if n == 1:
            if not total:
                return 1.0
            base = total if left > 0 else total + 1
            c = counts[1].get((word,), 0)
            return of(1, c) * c / base if c else (left / total if left > 0 else 1 / (total + 1))
        seen = after[n].get(history)
        if not seen:
            return probability(n - 1, history[1:], word)
        events, free = sum(seen.values()), sum((1 - of(n, c)) * c for c in seen.values())
        base, share = (events, free) if free > 0 else (events + 1, 1)
        if word in seen:
            return of(n, seen[word]) * seen[word] / base
        if (n, history) not in weights:
            weights[n, history] = share / base / (1 - sum(probability(n - 1, history[1:], w) for w in seen))
        return weights[n, history] * probability(n - 1, history[1:], word)

    out = []
    for t, is_held in zip(tokens, held):
        padded = ["<s>"] * (order - 1) + t
        out.append((is_held, len(t), sum((w,) in counts[1] for w in t), total,
                    sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (types + 1))) for w in t),
                    sum(math.log10(probability(order, tuple(padded[i:i + order - 1]), padded[i + order - 1])) for i in range(len(t)))))
    return out, probability, after, counts


def remainder(doc_id, of):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


def overlaps(rows, items, window=10):
    """(words, hit words, items, digest) per row."""
    split = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(s))
    windows = defaultdict(set)
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i:i + n])].update([] if name is None else [str(name)])
    out = []
    for _, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    found |= windows[tuple(w[i:i + n])]
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
