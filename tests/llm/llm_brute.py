"""Plain versions of the operators, for comparison."""


def brute_sets(texts):
    """5-word shingle sets by plain Python."""
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute_components(rows):
    """Smallest id reachable by links of Jaccard 0.8 and more, all pairs compared."""
    sets = brute_sets([t for _, t in rows])
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                above[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {g: min((rows[i][0] for i in members if rows[i][0] is not None), default=None) for g, members in groups.items()}
    return [(rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[root(i)]) for i in range(len(rows))]
