"""Brute-force versions of the training-data operators."""

import math
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def near_duplicates(rows, percent=75):
    """doc_id -> (shingles, component)."""
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            owners[x].append(k)
    for k, s in sets.items():
        common = Counter(o for x in s for o in owners[x] if o < k)
        for o, i in common.items():
            if 100 * i >= percent * (len(s) + len(sets[o]) - i):
                a, b = find(k), find(o)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def contamination(rows, items, window=10):
    """doc_id -> (words, hits, items)."""
    word, wins = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), defaultdict(set)
    for k, t in items:
        w = word.findall(lower(t or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(k)
    out = {}
    for k, t in rows:
        w, hit, found = word.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out[k] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


def repeats(rows, length=100):
    """doc_id -> (bytes, runs, kept)."""
    seen, out = set(), {}
    for k, raw in sorted(((k, (t or "").encode()) for k, t in rows), key=lambda x: x[0]):
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(w)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        out[k] = (len(raw), runs, bytes(x for x, c in zip(raw, cover, strict=True) if not c))
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney of an order over plain dictionaries."""

    def __init__(self, texts, order):
        self.order, self.uni, top = order, Counter(), Counter()
        for t in texts:
            w = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            self.uni.update(w[order - 1 :])
            top.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.after, self.total, self.d = defaultdict(lambda: [0, 0, 0]), Counter(), {}
        for k, grams in self.counts.items():
            self.d[k] = self.discount(grams.values())
            for g, n in grams.items():
                self.after[k, g[:-1]][min(n, 3) - 1] += 1
                self.total[k, g[:-1]] += n
        self.v, self.n, self.types = len(self.uni), sum(self.uni.values()), len(self.counts[2])

    @staticmethod
    def discount(counts):
        n = Counter(min(x, 5) for x in counts)
        if min(n[k] for k in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k), k) for k in (1, 2, 3)]]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.v + 1)
        if not (total := self.total[k, gram[:-1]]):
            return self.p(gram[1:])
        n, d = self.counts[k][gram], self.d[k]
        return max(n - d[min(n, 3)], 0) / total + sum(d[i + 1] * self.after[k, gram[:-1]][i] for i in range(3)) / total * self.p(gram[1:])

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + words(text) + ["</s>"]
        own = w[self.order - 1 :]
        base = sum(math.log10((self.uni[c] + 0.5) / (self.n + 0.5 * (self.v + 1))) for c in own)
        return len(own), sum(self.uni[c] > 0 for c in own), base, sum(math.log10(self.p(tuple(w[i : i + self.order]))) for i in range(len(own)))


class Ftrl:
    """FTRL-proximal logistic regression over named features, a coordinate at a time; None is the bias, without L1."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = defaultdict(float), defaultdict(float)

    @staticmethod
    def features(text):
        w = re.findall("[0-9a-z]+", lower(text or ""))
        out = {None, *((x,) for x in w), *(("head", x[:5]) for x in w if len(x) > 5)}
        return out | {(gap, a, b) for gap in (1, 2) for a, b in zip(w, w[gap:], strict=False)}

    def weight(self, f):
        z, l1 = self.z[f], 0.0 if f is None else self.l1
        if abs(z) <= l1:
            return 0.0
        return -(z - math.copysign(l1, z)) / ((self.beta + math.sqrt(self.n[f])) / self.alpha + self.l2)

    def score(self, text):
        return 1 / (1 + math.exp(-sum(self.weight(f) for f in self.features(text))))

    def learn(self, text, label):
        g = self.score(text) - label
        for f in self.features(text):
            rate = (math.sqrt(self.n[f] + g * g) - math.sqrt(self.n[f])) / self.alpha
            self.z[f] += g - rate * self.weight(f)
            self.n[f] += g * g
