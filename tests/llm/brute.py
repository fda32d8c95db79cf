"""Plain answers that the operators are held against."""

import collections


def linked(ids, links):
    """Smallest id reachable from each id."""
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def removed(texts, length=200):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        yield spans
