"""Plain versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPLIT.findall(text or "")


def reach(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingles(text, k=4):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(docs, k=4, percent=85):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = reach(links, ids)
    return sorted((i, len(sets[i]), comp[i]) for i in ids)


def repeats(docs, size=50):
    import hashlib

    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def near(vectors, cosine=0.9):
    ok = {i: v for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = [(a, b) for a in ids for b in ids if a < b and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= cosine]
    n = Counter(x for pair in links for x in pair)
    comp = reach(links, [i for i, _ in vectors])
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _ in vectors)


def base_scores(docs):
    tok = lambda t: [*words(lower(t)), None]
    c = Counter(x for i, t in docs if zlib.crc32(str(i).encode()) % 10 for x in tok(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok(t))) for i, t in docs}
