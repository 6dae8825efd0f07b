"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

W = "\x20\x09-\x0d"


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(f"[^{W}]+", text or "")


def shingles(text: str | None, k: int) -> frozenset:
    w = words(low(text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def roots(ids, links) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(ids, linked)
    return {d: (len(sets[d]), root[d]) for d in ids}


def lines(docs):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != d)]
        out[d] = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def substrings(docs, least=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def targets(docs):
    """docs: (id, text, source). Returns the source's size and target."""
    size = Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            open_.discard(s)
        left = sum(size.values()) - sum(target.values())
    return size, target


def contained(docs, items, k=5, percent=80):
    def of(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def held(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + m]) for m in range(1, k + 1) for i in range(len(w) - m + 1)}

    out = {}
    for d, t in docs:
        own = held(t)
        for i, x in items:
            q = of(x)
            if q and 100 * len(q & own) >= percent * len(q):
                out[d, i] = (len(q), len(q & own))
    return out


def vectors(rows, least=0.93):
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    linked = [(a, b) for i, (a, v, la) in enumerate(rows) for b, w, lb in rows[i + 1 :] if la is not None and la == lb and fine(v) and fine(w) and len(v) == len(w) and cosine(v, w) >= least]
    n = Counter(x for pair in linked for x in pair)
    root = roots([r[0] for r in rows], linked)
    return {r[0]: (n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


class alergia:  # noqa: N801
    """ALERGIA as it is written down: a prefix tree of words with the words kept at each state, merged by recursion. Probabilities have one count
    more in the denominator."""

    def __init__(self, words, alpha=0.01, fewest=16):
        self.alpha, self.fewest = alpha, fewest
        prefixes = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (min(j for j, w in enumerate(sorted(words)) if w.startswith(p)), len(p)))
        self.next = {p: {} for p in prefixes}
        self.n, self.ends = Counter(), Counter()
        for w in words:
            self.ends[w] += 1
            for i in range(len(w) + 1):
                self.n[w[:i]] += 1
                if i < len(w):
                    self.next[w[:i]][w[i]] = w[: i + 1]
        self.edge = {(p, c): self.n[q] for p, out in self.next.items() for c, q in out.items()}
        born = {p: i for i, p in enumerate(prefixes)}
        red = [b""]
        while blue := sorted(((q, p, c) for p in red for c, q in self.next[p].items() if q not in red), key=lambda x: (born[x[0]], red.index(x[1]), x[2])):
            q, p, c = blue[0]
            for r in red:
                if self.alike(r, q):
                    self.next[p][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
        self.n_states = len(red)

    def shares(self, p):
        out = {c: self.edge[p, c] for c in self.next[p]}
        return {**out, "end": self.ends[p]}, sum(out.values()) + self.ends[p]

    def alike(self, a, b):
        (x, n), (y, m) = self.shares(a), self.shares(b)
        if n and m:
            if min(n, m) < self.fewest and (x["end"] == n) != (y["end"] == m):
                return False
            bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > bound for c in {*x, *y}):
                return False
            return all(self.alike(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c])
        return True

    def fold(self, a, b):
        if a == b:
            return
        self.ends[a] += self.ends[b]
        for c, q in list(self.next[b].items()):
            self.edge[a, c] = self.edge.get((a, c), 0) + self.edge[b, c]
            if c in self.next[a]:
                self.fold(self.next[a][c], q)
            else:
                self.next[a][c] = q

    def log_probability(self, w):
        p, total = b"", 0.0
        for c in w:
            x, n = self.shares(p)
            total += math.log(x[c] / (n + 1))
            p = self.next[p][c]
        x, n = self.shares(p)
        return total + (math.log(x["end"] / (n + 1)) if x["end"] else math.log(1e-6))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x, y, l2=0.3):
    """Weights and intercept by plain Newton steps on a dense matrix."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.diag([*[l2] * (x.shape[1] - 1), 1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + shrink, x.T @ (p - y) + shrink @ w)
        size = 1.0
        loss = lambda v: np.sum(np.logaddexp(0, x @ v) - y * (x @ v)) + 0.5 * v @ shrink @ v
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return w


def predict(x, w):
    return sigmoid(x @ w[:-1] + w[-1])


def telling(lists, labels, most, least):
    """Features by the largest chi-squared to any label, ascending."""
    n, best = len(lists), {}
    for f in sorted({f for x in lists for f in x}):
        has = np.array([f in x for x in lists])
        seen = has.sum()
        if least <= seen < n:
            best[f] = max((has @ y - seen * y.mean()) ** 2 / max(seen * y.mean() * (1 - y.mean()) * (1 - seen / n), 1e-9) for y in labels)
    top = sorted(best, key=lambda f: (-best[f], f))[:most]
    return sorted(f for f in top if best[f] > 10.8)


def matrix(lists, names):
    return np.array([[float(f in x) for f in names] for x in map(set, lists)])


def chain(lists, stats, labels, folds=4, features=1500):
    """Out-of-fold and final probabilities of each category, each fitted beside the ones before."""
    names = telling(lists, list(labels.T.astype(float)), features, 8)
    x = np.hstack([matrix(lists, names), stats])
    train = test = x
    fold, out, final = np.arange(len(x)) % folds, [], []
    for y in labels.T.astype(float):
        held = np.zeros(len(x))
        for f in range(folds):
            held[fold == f] = predict(train[fold == f], logistic(train[fold != f], y[fold != f]))
        final.append(predict(test, logistic(train, y)))
        train, test = np.hstack([train, held[:, None]]), np.hstack([test, final[-1][:, None]])
        out.append(held)
    return np.stack(out, 1), np.stack(final, 1)


def co_training(views, y, fit, held, free, sure=0.95, rounds=3):
    """views: two matrices of all rows; y: labels of the labelled ones, by row; free: the unlabelled rows. Calibrated and combined probabilities."""
    known = np.array([y[i] for i in fit], float)
    weights = [logistic(x[fit], known) for x in views]
    for _ in range(rounds):
        judged, new = [predict(x[free], w) for x, w in zip(views, weights, strict=True)], []
        for v, x in enumerate(views):
            p = judged[1 - v]
            some = (p >= sure) | (p <= 1 - sure)
            new.append(logistic(np.vstack([x[fit], x[free][some]]), np.concatenate([known, p[some] > 0.5])))
        weights = new
    z = [x @ w[:-1] + w[-1] for x, w in zip(views, weights, strict=True)]
    true = np.array([y[i] for i in held], float)
    scales = [logistic(o[held, None], true, 0.1) for o in z]
    both = np.stack([o * s[0] + s[1] for o, s in zip(z, scales, strict=True)], 1)
    return np.hstack([sigmoid(both), predict(both, logistic(both[held], true, 0.1))[:, None]])
