"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, n=50):
    """docs: [(id, text)] -> {(id, n_words, n_removed, kept_sha256)}."""
    first = {}
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if i is not None and first[tuple(w[a : a + n])] < i:
                gone[a : a + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss if i is not None and s]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            holders[x].append(k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(flat):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < k:
                    shared[j] += 1
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(flat[j][1]) - c):
                a, b = sorted((find(i), find(flat[j][0])))
                root[b] = a
    out = []
    for i, t in docs:
        c = None if i is None else find(i)
        out.append((i, len(shingles(t)), c, c == i))
    return out


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def decontaminate(docs, items, n=10):
    grams = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if k else ():
            grams[tuple(w[a : a + k])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit.update(range(a, a + k))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out
