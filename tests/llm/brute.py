"""Plain versions of the operators, for comparison on small tables."""

from collections import Counter, defaultdict


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shingle_bag(text):
    ws = (text or "").encode().split()
    if len(ws) < 5:
        return Counter([tuple(ws)] if ws else [])
    return Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))


def near_classes(rows):
    """Class id (smallest doc_id) of each (doc_id, text): equal texts, and weighted Jaccard >= 0.8."""
    rows = list(rows)
    bags = [shingle_bag(t) for _, t in rows]
    parent = list(range(len(rows)))
    by_text, by_shingle = {}, defaultdict(list)
    for i, (_, t) in enumerate(rows):
        j = by_text.setdefault(t or "", i)
        parent[find(parent, i)] = find(parent, j)
        if i == j:
            for s in bags[i]:
                by_shingle[s].append(i)
    overlap = Counter()
    for s, group in by_shingle.items():
        for x in range(len(group)):
            for y in range(x):
                overlap[group[y], group[x]] += min(bags[group[x]][s], bags[group[y]][s])
    for (a, b), both in overlap.items():
        if 5 * both >= 4 * (bags[a].total() + bags[b].total() - both):
            parent[find(parent, a)] = find(parent, b)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(parent, i)
            names[r] = min(names.get(r, d), d)
    return sorted(((d, names.get(find(parent, i))) for i, (d, _) in enumerate(rows)), key=str)
