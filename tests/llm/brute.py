"""Plain versions of the operators, for small inputs."""

import re

UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def jaccard_components(rows, k=5, percent=80):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                if (h[b], h[a]) not in seen:
                    seen.add((h[b], h[a]))
                    i = len(sets[h[a]] & sets[h[b]])
                    if 100 * i >= percent * (len(sets[h[a]]) + len(sets[h[b]]) - i):
                        up[find(h[a])] = find(h[b])
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)
