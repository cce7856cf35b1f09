"""Plain Python versions of what the operators must give, for small inputs."""

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_documents(texts):
    """{doc_id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def best_fit_decreasing(lengths, window):
    """Windows as lists of lengths, piece by piece."""
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in windows if window - sum(w) >= n]
        if fits:
            min(fits, key=lambda w: window - sum(w)).append(n)
        else:
            windows.append([n])
    return windows


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def water_fill(sizes, weights, share=1.5, epochs=2):
    wanted, capped = share * sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        if not rest:
            return [float(epochs * s) for s in sizes]
        level = (wanted - sum(epochs * sizes[i] for i in capped)) / sum(weights[i] for i in rest)
        over = {i for i in rest if epochs * sizes[i] <= level * weights[i]}
        if not over:
            return [float(epochs * s) if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= over
