"""The operators once more, in plain Python over lists, as slow and as direct as can be."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np


def repeated_windows(docs, split, join, window):
    """doc -> (n, n_removed, n_spans, digest) for (doc, text) pairs; the dictionary meets windows in order."""
    first, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        tokens = split(text)
        gone = [False] * len(tokens)
        for i in range(len(tokens) - window + 1):
            key = tuple(tokens[i : i + window]) if isinstance(tokens, list) else tokens[i : i + window]
            if first.setdefault(key, (doc, i)) != (doc, i):
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = join([t for t, g in zip(tokens, gone, strict=True) if not g])
        out[doc] = (len(tokens), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def words(docs, window=20):
    return repeated_windows(docs, lambda t: (t or "").encode().split(), b" ".join, window)


def strings(docs, length=100):
    return repeated_windows(docs, lambda t: (t or "").encode(), bytes, length)


def lines(docs, run=2, long=50):
    """doc -> (n_lines, n_removed, digest): runs of `run` lines, and lines of `long` words, that also start earlier."""
    first, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ls, gone = (text or "").split("\n"), set()
        for i in range(len(ls)):
            if i + run <= len(ls) and first.setdefault(tuple(ls[i : i + run]), (doc, i)) != (doc, i):
                gone |= set(range(i, i + run))
            if long and len(ls[i].encode().split()) >= long and first.setdefault(ls[i], (doc, i)) != (doc, i):
                gone.add(i)
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out[doc] = (len(ls), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def reach(nodes, links):
    """node -> smallest node reachable."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def simhash(text):
    import xxhash

    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def near_texts(docs):
    """doc -> (fingerprint, component)."""
    prints = [(d, simhash(t)) for d, t in docs]
    fp = np.array([p for _, p in prints], dtype=np.uint64)
    links = []
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3):
            links.append((prints[i][0], prints[i + 1 + int(j)][0]))
    component = reach([d for d, _ in prints], links)
    return {d: (f"{p:016x}", component[d]) for d, p in prints}


def vectors(rows, threshold=0.9):
    """id -> (links, component)."""
    good = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = x / np.sqrt(x @ x)
    ids = sorted(good)
    cos = np.array([good[i] for i in ids]) @ np.array([good[i] for i in ids]).T if ids else np.empty((0, 0))
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(cos >= threshold, 1)), strict=True)]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    component = reach([i for i, _ in rows], links)
    return {i: (count[i], component[i]) for i, _ in rows}


def edits(docs):
    """doc -> digest of the edited text."""
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        out[d] = hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
    return out


def pieces(docs, library, capacity=4096):
    """(doc, piece) -> (start, length, crc)."""
    out = {}
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[d, k // capacity] = (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    return out


def shares(size_of, weights=(5, 2, 1), most=3):
    """source -> target, by sharing again and again what is above a source's limit."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, total, out = set(order), float(sum(size_of.values())), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        above = {s for s in left if level * weight[s] > most * size_of[s]}
        if not above:
            return out | {s: level * weight[s] for s in left}
        out |= {s: float(most * size_of[s]) for s in above}
        left -= above
    return out
