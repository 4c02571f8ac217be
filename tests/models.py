"""Plain Python models of the operators, for small inputs."""

from __future__ import annotations

import math
from collections import Counter

# Fixed value: characters that become a space.
FILTERS = set('!"#$%&()*+,-./:;=?@[\\]^_`{|}~\t\n')


def words(text, chars=FILTERS):
    plain = "".join(" " if c in chars else c for c in text.lower())
    return [w for w in plain.split(" ") if w]


def vocabulary(documents, cap=None):
    """Word to id; ``documents`` is a list of word lists in document order."""
    seen = Counter()
    for document in documents:
        seen.update(document)
    seen.pop("<unk>", None)
    # Counter keeps first-seen order and sorted() is stable.
    ranked = sorted(seen, key=lambda w: -seen[w])
    return {w: i for i, w in enumerate(ranked, start=2) if cap is None or i < cap}


def encode(document, vocab, length=None):
    ids = [vocab.get(w, 1) for w in document]
    return ids if length is None else (ids + [0] * length)[:length]


def repeated(text, n):
    parts, places = text.split(), {}
    for at in range(len(parts) - n + 1):
        places.setdefault(tuple(parts[at:at + n]), []).append(at)
    return [" ".join(gram) for gram, found in places.items() if len(found) > 1]


def beam(scores, key, start, length, k, n, lineage=False):
    """Final (tokens, score) by slot, or None when some hypothesis has fewer than k allowed followers."""
    def followers(prev, banned):
        allowed = [(p, t) for t, p in scores.get((key, prev), {}).items() if t not in banned]
        return sorted(allowed, key=lambda x: (-x[0], x[1]))[:k]

    first = followers(start, ())
    if len(first) < k:
        return None
    beams = [((start, t), math.log(p)) for p, t in first]
    memory = [set() for _ in range(k)]
    for position in range(2, length):
        merged = []
        for slot, (tokens, score) in enumerate(beams):
            banned = set()
            if n > 1 and position > n:
                grams = {tokens[i:i + n] for i in range(len(tokens) - n + 1)}
                memory[slot] = grams if lineage else memory[slot] | grams
                tail = tokens[-(n - 1):]
                banned = {g[-1] for g in memory[slot] if g[:-1] == tail} | {tokens[-1]}
            best = followers(tokens[-1], banned)
            if len(best) < k:
                return None
            for col, (p, t) in enumerate(best):
                total = score + math.log(p)
                merged.append((-round(total, 9), slot, col, tokens + (t,), total))
        beams = [(tokens, total) for *_, tokens, total in sorted(merged)[:k]]
    return beams
