"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import math

import numpy as np
import xxhash

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    found, word = [], ""
    for letter in (text or "") + " ":
        if letter in WHITE:
            if word:
                found.append(word)
            word = ""
        else:
            word += letter
    return found


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = words(lower)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """Smallest node that each node reaches, comparing all pairs."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}


def embedding_links(rows, threshold=0.9):
    """{vec_id: (links, component)} by brute force in double precision."""
    usable, units = [], []
    for vec_id, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            usable.append(vec_id)
            v = np.array(vector, float)
            units.append(v / np.linalg.norm(v))
    link = np.array(units) @ np.array(units).T >= threshold if units else np.zeros((0, 0), bool)
    counts = link.sum(axis=1) - 1
    component = {v: v for v, _ in rows}
    seen = set()
    for at in np.argsort(usable):
        if at in seen:
            continue
        front, members = [at], {at}
        while front:
            near = set(np.flatnonzero(link[front.pop()])) - members
            members |= near
            front += near
        seen |= members
        for m in members:
            component[usable[m]] = min(usable[k] for k in members)
    found = {v: (0, v) for v, _ in rows}
    found.update({v: (int(n), component[v]) for v, n in zip(usable, counts)})
    return found


def repeated_words(text):
    found = words(text)
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i:i + 8]), []).append(i)
    return len({j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)})
