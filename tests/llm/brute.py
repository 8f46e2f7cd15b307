"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for p in [0] if 0 < len(w) < size else range(len(w) - size + 1):
            windows[tuple(w[p:p + size])].add(str(item))
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p:p + n])) in windows:
                    found |= windows[x]
                    hit |= set(range(p, p + n))
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, size=35):
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[p:p + size]) for w in split for p in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(docs, split):
        hit = {q for p in range(len(w) - size + 1) if seen[tuple(w[p:p + size])] > 1 for q in range(p, p + size)}
        out.append((doc, len(w), len(hit), sha(" ".join(x for i, x in enumerate(w) if i not in hit))))
    return out


def shingles(text):
    w = words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(docs):
    """(number of shingles, component as least place) for every place."""
    sets = [shingles(t) for _, t in docs]
    union = Union()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                union.join(i, j)
    return [(len(a), union.find(i)) for i, a in enumerate(sets)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def private(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [(s, k, e) for s, _, k, e in sorted(found)]


def quality(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {q for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for q in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
