"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def text_of(value):
    return (value or "").encode()


def shingles(value):
    words = text_of(value).lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def classes(ids, linked):
    """Smallest id reachable from each id by ``linked(i, j)`` over positions."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def near_duplicates(rows):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)

    return [(doc, len(s), c) for (doc, _), s, c in zip(rows, sets, classes([r[0] for r in rows], linked))]


def without_earlier(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = text_of(text).split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def without_repeated_bytes(rows, length=400):
    counts = {}
    for _, text in rows:
        data = text_of(text)
        for i in range(len(data) - length + 1):
            counts[data[i:i + length]] = counts.get(data[i:i + length], 0) + 1
    out = {}
    for doc, text in rows:
        data = text_of(text)
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if counts[data[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def edit_distance_to_prefix(item, text):
    """Least edit distance between ``item`` and a prefix of ``text``."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)
