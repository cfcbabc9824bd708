"""Plain versions of what the stages of the pipeline keep."""

D = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words)))))


def left_by_brute_force(rows):
    """Of rows (id, text) the one with the smallest id of each group, nulls last."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    best = {}
    for (i, t), r in zip(rows, root):
        if r not in best or (i is None, i or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = (i, t)
    return list(best.values())
