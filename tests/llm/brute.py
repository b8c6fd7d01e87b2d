"""Plain statements of the operators' results, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substring_dedup(rows, window=20):
    """rows: (id, text) with distinct ids; returns {id: (n_words, n_removed, sha)}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        ws = WORD.findall(text or "")
        gone = set()
        for at in range(len(ws) - window + 1):
            w = tuple(ws[at:at + window])
            if w in seen:
                gone.update(range(at, at + window))
            seen.add(w)
        kept = " ".join(w for n, w in enumerate(ws) if n not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, k):
    ws = WORD.findall((text or "").translate(LOWER))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def jaccard_components(rows, k=4, percent=85):
    """rows: (id, text) with distinct ids; returns {id: (n_shingles, component)}."""
    sets = {i: shingles(t, k) for i, t in rows}
    by_column = {}
    for i, s in sets.items():
        for x in s:
            by_column.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in by_column[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
