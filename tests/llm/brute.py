"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, values, radius=4):
    """For each id the smallest id that links of at most radius bits reach."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def windows(items, n=13):
    out = {}
    for item, text in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            out.setdefault(tuple(words[i : i + k]), set()).add(item)
    return out


def contamination(text, found):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, items = set(), set()
    for n in {len(w) for w in found}:
        for i in range(len(words) - n + 1):
            if own := found.get(tuple(words[i : i + n])):
                hit |= set(range(i, i + n))
                items |= own
    digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def line_dedup(docs, window=3, min_words=1):
    """docs: (id, text) in order of id; texts without later windows."""
    from barline.llm.linededup import lines_of

    seen, out = {}, {}
    for i, text in docs:
        lines = lines_of((text or "").encode())
        keys = [x.lower().strip() for x in lines]
        covered, own = set(), {}
        for p in range(len(lines) - window + 1):
            if sum(k.count(b" ") + 1 for k in keys[p : p + window]) < min_words:
                continue
            key = tuple(keys[p : p + window])
            if seen.setdefault(key, i) != i:
                covered |= set(range(p, p + window))
            if key in own:
                covered |= set(range(max(p, own[key] + window), p + window))
            else:
                own[key] = p
        out[i] = b"".join(x for q, x in enumerate(lines) if q not in covered).rstrip().decode() if covered else text
    return out


def inner(v, w):
    total = 0.0
    for a, b in zip(map(float, v), map(float, w)):
        total += a * b  # sum() would compensate
    return total


def nearest(vectors, k, every):
    """vectors: id -> array; (query, rank) -> (id, score)."""
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            found = sorted((-inner(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out |= {(q, r): (i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


def tokens(word, pieces, unknown):
    """Number of tokens of the best split; of equal ones that with the longest last piece."""
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        options = []
        for i in range(j):
            p = word[i:j]
            if p in pieces:
                options.append((best[i][0] + pieces[p], best[i][1] + 1))
            elif i == j - 1:
                options.append((best[i][0] + unknown, best[i][1] + len(p.encode())))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1]


def vector(rng, n=16):
    return np.round(rng.normal(size=n), 3)
