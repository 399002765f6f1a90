"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACE = "[^\x20\x09-\x0d]+"


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def cut_repeats(rows, k=13):
    first = {}
    words = {d: re.findall(SPACE, t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingles(text, k):
    w = re.findall(SPACE, ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_duplicates(rows, k=2, percent=80):
    sets = {d: shingles(t, k) for d, t in rows}
    owners = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            owners[x].append(d)
    both = defaultdict(int)
    for ds in owners.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))


def benchmark_hits(rows, items, k=10):
    owners = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for at in range(max(1, len(w) - k + 1)):
            if w:
                owners[tuple(w[at : at + k])].add(str(i))
    sizes = {len(x) for x in owners}
    out = {}
    for d, t in rows:
        w, hit, found = item_words(t), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if (run := tuple(w[at : at + size])) in owners:
                    hit.update(range(at, at + size))
                    found |= owners[run]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
