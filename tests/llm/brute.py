"""Plain restatements that the operators are held against."""

import numpy as np
import xxhash


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, size=4):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in lower.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_components(prints, threshold):
    p = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= threshold)
    return components(len(p), zip(a.tolist(), b.tolist()))
