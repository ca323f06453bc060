"""Brute-force versions that several tests compare with."""


def brute_lines(docs, least):
    """{id: numbers of the lines that go} for (id, text) in order."""
    texts = [(i, t.split("\n")) for i, t in sorted(docs) if t is not None]
    gone = {}
    for d, (i, lines) in enumerate(texts):
        out = set()
        for s in range(len(lines)):
            best = 0
            for e, (_, other) in enumerate(texts[: d + 1]):
                for m in range(len(other) if e < d else s):
                    k = 0
                    while s + k < len(lines) and m + k < len(other) and (e < d or m + k < s) and lines[s + k] == other[m + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(len(x.split()) for x in lines[s : s + best]) >= least:
                out |= set(range(s, s + best))
        gone[i] = sorted(out)
    return gone


def brute_near(data):
    """{id: (shingles, component)} for (id, text)."""
    sets = {}
    for i, t in data:
        w = (t or "").lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            p, q = sets[a], sets[b]
            if p and q and 100 * len(p & q) >= 75 * len(p | q):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
