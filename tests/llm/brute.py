"""Plain restatements of the operators for small inputs."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np

from webtally.llm.katz import LOW, discounts


def crc_rest(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def nearest(vectors: dict[int, list], asked: list[int], k: int) -> dict[int, list[tuple]]:
    out = {}
    for q in asked:
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def near_copies(docs: list[tuple], threshold: float = 0.8, n: int = 5) -> dict:
    """doc_id to (class, number of links), ids distinct."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    root, links = list(range(len(docs))), [0] * len(docs)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return {doc: (least[top(i)], links[i]) for i, (doc, _) in enumerate(docs)}


def without_repeats(docs: list[tuple], min_words: int) -> dict:
    """doc_id to the text that is left: every run of lines with ``min_words`` words that occurs earlier goes."""
    sequences = []
    for doc, text in sorted(docs):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip()]
        sequences.append((doc, lines, solid))
    first: dict = {}
    out = {}
    for doc, lines, solid in sequences:
        gone = set()
        for a in range(len(solid)):
            words = 0
            for b in range(a, len(solid)):
                words += len(lines[solid[b]].split())
                run = tuple(lines[i] for i in solid[a : b + 1])
                if words >= min_words and first.setdefault(run, (doc, a)) < (doc, a):
                    gone.update(range(solid[a], solid[b] + 1))
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def katz(docs: list[tuple]) -> dict:
    """doc_id to (held out, tokens, known, base score, score)."""
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + ["<end>"] for d, t in docs}
    one, two = collections.Counter(), collections.Counter()
    for doc, own in tokens.items():
        if crc_rest(doc, 10):
            one.update(own)
            two.update(zip(["<s>", *own[:-1]], own))

    def low(counts):
        how_often = collections.Counter(counts.values())
        return [how_often[r] for r in range(1, LOW + 2)]

    d1, d2 = discounts(low(one)), discounts(low(two))
    total, distinct = sum(one.values()), len(one)

    def discount(d, r):
        return d[r - 1] if r <= LOW else 1.0

    single = {w: total / (total + 1) * discount(d1, c) * c / total for w, c in one.items()}
    unknown = 1 - sum(single.values())
    history, seen, lower = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, _), c in two.items():
        history[h] += c
    for (h, w), c in two.items():
        seen[h] += discount(d2, c) * c / (history[h] + 1)
        lower[h] += single[w]

    def p(h, w):
        if (h, w) in two:
            return discount(d2, two[h, w]) * two[h, w] / (history[h] + 1)
        own = single.get(w, unknown)
        return (1 - seen[h]) / (1 - lower[h]) * own if history[h] else own

    # Everything that can follow a history adds up to one.
    for h in list(history)[:5]:
        assert math.isclose(sum(p(h, w) for w in [*one, "<no such word>"]), 1, rel_tol=1e-9)
    return {
        doc: (
            crc_rest(doc, 10) == 0, len(own), sum(t in one for t in own),
            sum(math.log10((one[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own),
            sum(math.log10(p(h, w)) for h, w in zip(["<s>", *own[:-1]], own)))
        for doc, own in tokens.items()
    }


def vectors(n: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, d))
