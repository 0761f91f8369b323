"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile("[^\\x20\\x09-\\x0D]+").findall


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    roots = groups(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True))


def removed_lines(rows, t=0.8):
    lines = sorted((-(1 << 63) if d is None else d, k, frozenset(x.lower().split())) for d, text in rows if text is not None for k, x in enumerate(text.encode().split(b"\n")) if x.split())
    gone = defaultdict(set)
    for i, (d, k, a) in enumerate(lines):
        if any((e, m) < (d, k) and 5 * len(a & b) >= 4 * len(a | b) for e, m, b in lines[:i]):
            gone[d].add(k)
    return {d: sorted(x) for d, x in gone.items()}


def measures(text):
    words = WORDS(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Target of each source by its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    left, out = sum(sizes.values()), {}
    waiting = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    while waiting:
        share = {s: left * w / sum(waiting.values()) for s, w in waiting.items()}
        over = [s for s in waiting if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del waiting[s]
    return out


def without_near_copies(rows, width=5):
    """{doc_id: text} of the smallest doc_id of each group whose shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    roots = groups(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(d, least.get(r, d))
    return {d: t for (d, t), r in zip(rows, roots, strict=True) if least[r] == d}


def spans(rows, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(d, first.get(t[i : i + length], d))
    out = {}
    for d, t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone |= set(range(i, i + length))
        starts = [i for i in sorted(gone) if i - 1 not in gone]
        out[d] = (len(t), len(gone), len(starts), bytes(b for i, b in enumerate(t) if i not in gone))
    return out
