"""Plain versions of stages."""

from collections import defaultdict

from test_linededup import LOWER
from test_minhash import shingle_set


def kept_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    holds = defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holds[key(x)].add(d)
    return {d: "\n".join(x for x in t.split("\n") if len(holds[key(x)]) < 2 or d == min(holds[key(x)])) for d, t in docs.items()}


def near_duplicate_groups(docs, percent=80):
    """The least id of each group of texts linked by a similarity of `percent` or more."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    ids = sorted(docs)
    parent = {d: d for d in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {find(d) for d in ids}
