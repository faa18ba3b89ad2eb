"""Plain restatements of the operators' contracts for small inputs."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, width=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(grams))


def groups(items, linked):
    """Smallest index reachable for each item."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and linked(items[i], items[j]):
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def near_duplicates(rows, width=3, radius=2):
    """{id: (fingerprint, component)} of (id, text) rows with distinct ids."""
    rows = sorted(rows)
    fps = [fingerprint(t, width) for _, t in rows]
    found = groups(fps, lambda a, b: bin(a ^ b).count("1") <= radius)
    return {rows[i][0]: (fps[i], rows[found[i]][0]) for i in range(len(rows))}
