"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring(rows, win=20):
    """rows in order of documents -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), []
    for text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - win + 1):
            key = tuple(w[p : p + win])
            if key in seen:
                gone[p : p + win] = [True] * win
            seen.add(key)
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix(rows, win=200):
    rows = [(t or "").encode() for t in rows]
    count = Counter(b[p : p + win] for b in rows for p in range(len(b) - win + 1))
    out = []
    for b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - win + 1):
            if count[b[p : p + win]] > 1:
                gone[p : p + win] = [True] * win
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def near(rows):
    """{id: text} -> {id: (n_shingles, component)}."""
    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeat = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


def toxic_tokens(text):
    """Tokens of a text, and what stands for their inflected forms: (word, stem) each, as bytes."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words_ = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
    return [(("w", w), ("s", w[:4])) for w in words_]


def toxicity(train, texts, least_z=3.5, least_odds=1.0):
    """Scores of texts by a model fitted on (text, toxic) rows, from the definitions: log-odds, segments, extreme values, a logistic curve."""
    from math import exp, log, log1p, sqrt

    yes, no = Counter(), Counter()
    for text, toxic in train:
        for pair in toxic_tokens(text):
            for t in pair:
                (yes if toxic else no)[t] += 1
    n1, n0 = sum(yes.values()), sum(no.values())
    score, share = {}, {}
    for t in set(yes) | set(no):
        prior = 0.5 + 0.01 * (yes[t] + no[t])
        a1, a0 = yes[t] + prior, no[t] + prior
        s = log(a1 / (n1 - yes[t])) - log(a0 / (n0 - no[t]))
        if abs(s / sqrt(1 / a1 + 1 / a0)) >= least_z and abs(s) >= least_odds:
            score[t], share[t] = s, a0 / n0
    whole = max(1.0, sum(share.values()) / 0.9)
    share = {t: p / whole for t, p in share.items()}
    drift = -(0.05 + max(0.0, sum(share[t] * score[t] for t in score)))
    law = [(p, score[t]) for t, p in share.items()] + [(1 - sum(share.values()), drift)]
    low, high = 1e-3, 1.0
    f = lambda x: sum(p * exp(min(x * s, 700)) for p, s in law) - 1
    if max(s for _, s in law) <= 0:
        rate = 1.0
    else:
        while f(high) < 0 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        rate = (low + high) / 2

    def segments(text):
        """All maximal segments by definition: the best one, then the same on both its sides."""
        values = []
        for word, stem in toxic_tokens(text):
            a, b = score.get(word, 0.0), score.get(stem, 0.0)
            best = a if abs(a) > abs(b) else b
            values.append(best if best else drift)

        def maximal(v):
            sums = [0.0]
            for x in v:
                sums.append(sums[-1] + x)
            best = max(((sums[j] - sums[i], i - j, -i) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=(0, 0, 0))
            if best[0] <= 1e-9:
                return []
            i = -best[2]
            j = i - best[1]
            return [best[0], *maximal(v[:i]), *maximal(v[j:])]

        return len(values), maximal(values)

    seen = [(*segments(text), toxic) for text, toxic in train]
    clean = [(n, max(v, default=0.0)) for n, v, toxic in seen if not toxic]
    log_k = sum(rate * b - log(max(n, 1)) for n, b in clean) / len(clean) - 0.5772156649
    evidence = lambda n, v: log1p(sum(max(0.0, rate * s - log_k - log(max(n, 1))) for s in v))
    x, y = np.array([evidence(n, v) for n, v, _ in seen]), np.array([float(t) for *_, t in seen])
    w = np.zeros(2)
    for _ in range(200):  # Newton's method on the penalised likelihood
        d = np.stack([x, np.ones_like(x)], 1)
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2), d.T @ (p - y) + 1e-2 * w)
    return [1 / (1 + exp(-min(max(w[0] * evidence(*segments(t)) + w[1], -30), 30))) for t in texts]


def importance(raw, target, buckets, prior, strength):
    """Log weights of texts from exact n-gram counts; no two n-grams may share a bucket."""
    from math import log

    def grams(text):
        tokens = re.findall(r"\n|[^\W_]+|[^\w\s]+|_+", text or "")
        marked = [(t, any(i >= b and tokens[i - b] == t for b in (1, 2))) for i, t in enumerate(tokens)]
        return marked + list(zip(marked, marked[1:]))

    count = [Counter(g for t in texts for g in grams(t)) for texts in (target, raw)]
    total = [sum(c.values()) + buckets for c in count]
    odds = lambda g: log((count[0][g] + 1) / total[0]) - log((count[1][g] + 1) / total[1])
    return [strength * sum(map(odds, g)) / (len(g) + prior) for g in map(grams, raw)]


def mixed(rows, weights=(5, 2, 1), share=1.5, most=2.0, seed=7):
    """(id, source, text) rows with different ids, few enough for one shard a source -> {id: words taken}, word by word."""
    import heapq
    from math import ceil, gcd

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    docs = {s: sorted((i, len(words(t))) for i, own, t in rows if own == s) for s in sources}
    size = {s: sum(n for _, n in docs[s]) for s in sources}
    target, open_, rest = {}, list(sources), share * sum(size.values())
    while open_:
        weight = {s: weights[sources.index(s) % len(weights)] for s in open_}
        part = {s: rest * weight[s] / sum(weight.values()) for s in open_}
        full = [s for s in open_ if part[s] > most * size[s]]
        target |= {s: most * size[s] for s in full} if full else part
        rest -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    least = min((t for t in target.values() if t > 0), default=0)
    block = int(min(1024, max(16, least // 200)))
    blocks = {s: ceil(size[s] / block) for s in sources}
    quota, heap = dict.fromkeys(sources, 0), [(-target[s], k, s) for k, s in enumerate(sources) if blocks[s]]
    heapq.heapify(heap)
    for _ in range(min(round(sum(target.values()) / block), sum(2 * b for b in blocks.values()))):
        _, k, s = heapq.heappop(heap)
        quota[s] += 1
        if quota[s] < 2 * blocks[s]:
            heapq.heappush(heap, (-target[s] / (2 * quota[s] + 1), k, s))
    taken = {}
    for s in sources:
        n, at = blocks[s], 0
        if n:
            step = next(a for a in range(int(0.618 * n) | 1, 2 * n + 3) if gcd(a, n) == 1)
            shift = hash((seed, 0)) % n
        for i, words_ in docs[s]:
            taken[i] = 0
            for place in range(at, at + words_):
                j = place // block
                taken[i] += quota[s] // n + ((step * j + shift) % n < quota[s] % n)
            at += words_
    return taken


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    text, digits, out = text or "", lambda m: re.sub(r"[^0-9]", "", m), []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, good in rules:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m.group())]
    return out


def mcd(groups, share, steps, still, floor, prior, bins, quantiles):
    """{(lang, source): rows x statistics} -> {(lang, source): (mean, scatter)} by concentration steps, one language and source at a time.

    quantiles: {(lang, source): 3 x statistics}, the quartiles that a start uses.
    """
    from math import factorial

    d = next(iter(groups.values())).shape[1]

    def factor(q):
        cdf = lambda x, k: 1 - np.exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))
        low, high = 0.0, 200.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if cdf(mid, d) < q else (low, mid)
        return q / cdf(low, d + 2)

    best = {}
    start = {}
    for g, x in groups.items():
        q1, med, q3 = quantiles[g]
        mad = np.maximum((q3 - q1) / 1.349, floor)
        t = np.tanh((x - med) / mad)
        c = t.T @ t / len(x) + 1e-3 * np.eye(d)
        corr = (t.T @ t / len(x)) / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        shape = 0.9 * corr * (1 - np.eye(d)) + np.eye(d)
        start[g] = [(med, np.diag(mad**2)), (med, shape * np.outer(mad, mad))]
    now, moved = start, np.inf
    for _ in range(steps):
        kept = {}
        for g, x in groups.items():
            for k in (0, 1):
                mu, s = now[g][k]
                d2 = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(s), x - mu)
                b = np.floor(bins * np.log2(d2 + 1e-6))
                at = [(b < v).sum() < share * len(x) for v in b]
                kept[g, k] = x[at]
        new, moved = {}, 0.0
        for g, x in groups.items():
            new[g] = []
            for k in (0, 1):
                own = kept[g, k]
                f = factor(min(len(own) / len(x), 1 - 1e-9))
                mu, s = None, None
                for part in (np.concatenate([kept[h, k] for h in groups]), np.concatenate([kept[h, k] for h in groups if h[0] == g[0]]), own):
                    m, c = part.mean(0), f * np.cov(part.T, bias=True).reshape(d, d)
                    w = len(part) / (len(part) + prior) if mu is not None else 1.0
                    mu, s = (w * m + (1 - w) * mu, w * c + (1 - w) * s) if mu is not None else (m, c)
                s = s + floor**2 * np.eye(d)
                moved = max(moved, abs(np.linalg.slogdet(s)[1] - np.linalg.slogdet(now[g][k][1])[1]))
                new[g].append((mu, s))
        first, now = now is start, new
        if not first and moved < still:
            break
    for g in groups:
        best[g] = min(now[g], key=lambda e: np.linalg.slogdet(e[1])[1])
    return best
