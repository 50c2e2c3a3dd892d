"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def repeated(sequences, n):
    """Mask per sequence of the items in windows of n that start twice or more."""
    count = Counter()
    for s in sequences:
        for i in range(len(s) - n + 1):
            count[tuple(s[i:i + n]) if not isinstance(s, bytes) else s[i:i + n]] += 1
    out = []
    for s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - n + 1):
            if count[tuple(s[i:i + n]) if not isinstance(s, bytes) else s[i:i + n]] > 1:
                mask[i:i + n] = b"\1" * n
        out.append(mask)
    return out


def quality(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(repeated([w], 5)[0]))


def suffix_dedup(texts, n=400):
    raw = [(t or "").encode() for t in texts]
    out = []
    for b, m in zip(raw, repeated(raw, n)):
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((len(b), sum(m), spans, bytes(x for x, y in zip(b, m) if not y)))
    return out


def substring_dedup(texts, n=35):
    ws = [words(t) for t in texts]
    return [(len(w), sum(m), " ".join(x for x, y in zip(w, m) if not y)) for w, m in zip(ws, repeated(ws, n))]


class Components:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard_join(rows, percent=80):
    """rows of (id, text) -> per row (shingles, links, component)."""
    sets = [shingles(t) for _, t in rows]
    lists, links, comps = defaultdict(list), [0] * len(rows), Components(len(rows))
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                comps.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = comps.find(i)
        known = [k for k in (least.get(r), key) if k is not None]
        least[r] = min(known) if known else None
    return [(len(s), n, least[comps.find(i)]) for i, (s, n) in enumerate(zip(sets, links))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal_data(text):
    """Base spans (start, kind, end) in order."""
    t, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    )
    for kind, (pattern, ok) in enumerate(tests):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t) if ok(m.group())]
    return sorted(out)
