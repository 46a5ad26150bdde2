"""Brute-force versions that several tests share."""

import hashlib

import numpy as np
import xxhash


def split(text):
    return (text or "").encode().split()


def brute_fingerprint(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = text.encode().split()
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def components_of(prints, tau):
    """The smallest id of each id's component; prints: id to fingerprint."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_removed(units, width):
    seen, out = set(), []
    for u in units:
        hit = np.zeros(len(u), bool)
        for i in range(len(u) - width + 1):
            k = u[i : i + width] if isinstance(u, bytes) else tuple(u[i : i + width])
            if k in seen:
                hit[i : i + width] = True
            seen.add(k)
        out.append(hit)
    return out


def brute_kept(rows, width=5):
    """Indexes of the rows kept: the first (doc_id, null first) of each component, exact Jaccard >= 4/5."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    sets = {}
    for i in order:
        w = [x.lower() for x in split(rows[i][1])]
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(order):
        for j in order[:k]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b, key=order.index)] = min(a, b, key=order.index)
    return sorted(i for i in order if find(i) == i)


def brute_mix(rows, weights=(5, 2, 1), repeats=3, seed=9):
    """How often each of rows (doc_id, text, source) is taken: weighted fair queueing, one document at a time."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(split(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        share = {s: left * weight[s] / w for s in names if s not in capped}
        over = {s: float(repeats) * size[s] for s in share if share[s] > repeats * size[s]}
        if not over:
            break
        capped |= over
    target = share | capped
    key = lambda i: (int(hashlib.md5(f"{seed}:{'-' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}".encode()).hexdigest()[:15], 16), rows[i][0] or 0)
    queue, ahead = [], dict.fromkeys(size, 0)
    for i in sorted(range(len(rows)), key=key):
        n, s = len(split(rows[i][1])), rows[i][2]
        ahead[s] += n
        queue += [((e * size[s] + ahead[s]) / target[s], key(i), e, i, n) for e in range(repeats) if n]
    taken, left = [0] * len(rows), total
    for *_, i, n in sorted(queue):
        if n > left:
            break
        left -= n
        taken[i] += 1
    return taken
