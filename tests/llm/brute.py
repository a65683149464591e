"""Plain Python versions of what the operators compute, for small inputs."""

import collections
import hashlib
import math
import re

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


class Sets:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def least_ids(ids, sets):
    least = {}
    for n, i in enumerate(ids):
        if i is not None:
            least[sets.find(n)] = min(least.get(sets.find(n), i), i)
    return [least.get(sets.find(n)) for n in range(len(ids))]


def near_duplicates(rows, k, t):
    """Sorted (id, set size, component, kept) of rows (id, text)."""
    held, sets, inverse = [], Sets(len(rows)), collections.defaultdict(list)
    for n, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        held.append(frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
        shared = collections.Counter(b for x in held[n] for b in inverse[x])
        for b, m in shared.items():
            if 100 * m >= t * (len(held[n]) + len(held[b]) - m):
                sets.join(n, b)
        for x in held[n]:
            inverse[x].append(n)
    comp = least_ids([i for i, _ in rows], sets)
    return sorted(((i, len(held[n]), comp[n], i == comp[n]) for n, (i, _) in enumerate(rows)), key=str)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def cosine_links(rows, least):
    import numpy as np

    ok = [(n, np.array(v, float)) for n, (_, v) in enumerate(rows) if usable(v) and any(v)]
    sets, counts = Sets(len(rows)), [0] * len(rows)
    for a, (n, x) in enumerate(ok):
        for m, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                counts[n] += 1
                counts[m] += 1
                sets.join(n, m)
    comp = least_ids([i for i, _ in rows], sets)
    return sorted(((i, counts[n], comp[n], i == comp[n]) for n, (i, _) in enumerate(rows)), key=str)


def top_products(rows, by, modulus, k):
    held = [(i, [math.floor(by * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    asked = {}
    for i, v in held:
        if i % modulus == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in held if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -score) for r, (score, j) in enumerate(found[:k])]
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
