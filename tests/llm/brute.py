"""Plain Python versions of the set-based operators."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(texts, percent=75, width=5):
    """For every place in a list of texts: set size, places reachable by links, number of links."""
    sets = [shingles(t, width) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for own in holders.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                shared[a, b] += 1
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    links = Counter()
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            group[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(i)
    return [(len(sets[i]), members[find(i)], links[i]) for i in range(len(texts))]


def cut(texts, length):
    """Every text as bytes, the flags of its removed bytes."""
    bodies = [(t or "").encode() for t in texts]
    counts = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((b, gone))
    return out
