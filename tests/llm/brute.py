"""Plain versions of the operators, one row after another, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def token_rows(docs, vocabulary):
    """docs: (doc_id, text). Rows of doc_id, start, n_tokens, ids_crc32."""
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0], d[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def source_targets(sizes):
    """sizes: {source: words}. Targets by resharing what exceeds three times a source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free = set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else share[s]
        free -= over or free
    return target


def mix_rows(docs, seed=17):
    """docs: (doc_id, text, source) with distinct ids. doc_id -> words taken."""
    sized = [(d, len(words(t)), s, hashlib.md5(f"{seed}:{d}".encode()).hexdigest()) for d, t, s in docs]
    totals = {}
    for _, n, s, _ in sized:
        totals[s] = totals.get(s, 0) + n
    target = source_targets(totals)
    queue, upto = [], {}
    for d, n, s, key in sorted(sized, key=lambda r: r[3]):
        upto[s] = upto.get(s, 0) + n
        for epoch in range(3):
            done = epoch * totals[s] + upto[s]
            if n and done - n < target[s]:
                queue.append((done / target[s], (s is None, s or ""), epoch, key, d, n))
    taken, used = {d: 0 for d, *_ in sized}, 0
    for *_, d, n in sorted(queue):
        used += n
        if used > sum(totals.values()):
            break
        taken[d] += n
    return taken, target


def minimax(sizes, shards):
    """The smallest capacity with which greedy filling needs at most ``shards`` parts, and the ends."""

    def fill(capacity):
        ends, used = [], 0
        for i, size in enumerate(sizes):
            if used + size > capacity:
                ends.append(i)
                used = 0
            used += size
        return ends

    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(fill(middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return high, fill(high)


def shards_of(docs, shards=8):
    """docs: (doc_id, text). Text digest -> shard."""
    groups = {}
    for _, text in docs:
        raw = (text or "").encode()
        key = hashlib.sha256(raw).hexdigest()
        groups[key] = groups.get(key, 0) + len(raw) + 1
    keys = sorted(groups)
    _, ends = minimax([groups[k] for k in keys], shards)
    return {k: sum(i >= e for e in ends) for i, k in enumerate(keys)}


def removal_rows(docs, window=20):
    """docs: (doc_id, text) with distinct ids. doc_id -> (words, removed, digest of the kept)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        of_text = words(text)
        gone = set()
        for i in range(len(of_text) - window + 1):
            key = tuple(of_text[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(of_text) if i not in gone)
        out[doc_id] = (len(of_text), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_set(text):
    of_text = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    if not of_text:
        return set()
    return {tuple(of_text[i : i + 5]) for i in range(max(1, len(of_text) - 4))}


def component_rows(docs):
    """docs: (doc_id, text) with distinct ids. doc_id -> (set size, least linked id)."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


PARAGRAPH = re.compile(r"[^\n]{160,}?[.!?](?=\s|$)|[^\n]+", re.ASCII)


def version_rows(docs):
    """docs: (doc_id, text) with distinct ids. doc_id -> (characters, digest of the edited text, likenesses)."""

    def near(a, b):
        a, b = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
        return len(a & b) / len(a | b) if a | b else 1.0

    ordered = [(d, t or "") for d, t in sorted(docs, key=lambda d: (d[0] is not None, d[0]))]
    out = {}
    for (doc_id, text), (_, other) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, other)
        )
    return out
