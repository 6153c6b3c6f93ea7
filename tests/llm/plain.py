"""Plain Python versions of the operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def quality_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def shingles(text, k):
    w = WORD.findall(lower_ascii(text))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(texts, k, percent):
    """id -> (set size, smallest linked id), over all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in at[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found_items(texts, items, k=5, percent=80):
    sh = lambda t: {tuple(w[i : i + k]) for w in [ALNUM.findall((t or "").lower())] for i in range(len(w) - k + 1)}
    its = {i: s for i, t in items.items() if (s := sh(t))}
    out = set()
    for d, t in texts.items():
        s = sh(t)
        out |= {(d, i, len(q), len(q & s)) for i, q in its.items() if 100 * len(q & s) >= percent * len(q)}
    return out


def license_base(text):
    w = ALNUM.findall(lower_ascii(text))
    at = [(i, lab) for ph, lab in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for p in [ph.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))
