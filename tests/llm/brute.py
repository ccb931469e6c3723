"""Plain versions of the operators' results, over small tables held in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[SPACES.sub(" ", text or "")].append(doc_id)
    return sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def targets(sources, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Raise the level until no source is over its cap."""
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    total, capped = share * sum(sources.values()), set()
    while True:
        left = total - sum(cap * sources[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: cap * sources[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > cap * sources[s]}
        if not over:
            return out
        capped |= over


def shingles(text, n=5):
    w = [x for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(docs, threshold=0.8):
    """(id, class, links) with links at or over the threshold; ids must differ."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
            both = len(x & y)
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, find(i), links[i]) for i in sets)


def near_by_index(docs, threshold=0.8):
    """As `near`, with the overlaps counted shingle by shingle."""
    sets = {i: shingles(t) for i, t in docs}
    having, common, root, links = defaultdict(list), Counter(), {i: i for i in sets}, Counter()
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in having[s])
            having[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted((i, find(i), links[i]) for i in sets)


def top_k(vectors, k=5, scale=256, every=50):
    sound = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in sound:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in sound if c != q and len(x) == len(y))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def end_after(train, word):
    """log10 of the probability of the end after a word."""
    return kneser_ney(train, [], ask=(word, " "))


def kneser_ney(train, docs, ask=None):
    """{id: (n_tokens, n_known, N, base, score)} of an interpolated modified Kneser-Ney bigram model, word by word."""

    def words(text):
        return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + [" "]

    uni, bi = Counter(), Counter()
    for t in train:
        before = "<s>"
        for w in words(t):
            uni[w] += 1
            bi[before, w] += 1
            before = w
    total, v = sum(uni.values()), len(uni)
    ends, starts, context = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in bi.items():
        ends[b] += 1
        starts[a][min(c, 3)] += 1
        context[a] += c

    def discounts(counts):
        n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        if min(n[:3]) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    d, low_d = discounts(list(bi.values())), discounts(list(ends.values()))
    rest = sum(low_d[min(c, 3)] for c in ends.values()) / len(bi)

    def low(w):
        return (ends[w] - low_d[min(ends[w], 3)]) / len(bi) + rest / (v + 1) if w in ends else rest / (v + 1)

    def step(before, w):
        if not context[before]:
            return math.log10(low(w))
        c = bi[before, w]
        return math.log10((c - d[min(c, 3)]) / context[before] + sum(d[k] * n for k, n in starts[before].items()) / context[before] * low(w))

    if ask:
        return step(*ask)
    out = {}
    for i, t in docs:
        own, before, base, score = words(t), "<s>", 0.0, 0.0
        for w in own:
            base += math.log10((uni[w] + 1) / (total + v + 1))
            score += step(before, w)
            before = w
        out[i] = (len(own), sum(w in uni for w in own), total, base, score)
    return out


def held(doc_id, mod, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest
