"""The contracts of the text operators again, by the plainest means, for small tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(docs, symbols, width):
    """doc_id -> which symbols a window covers that starts earlier; docs in order."""
    seen, out = set(), {}
    for doc_id, text in docs:
        own = symbols(text or "")
        gone = [False] * len(own)
        for at in range(len(own) - width + 1):
            window = tuple(own[at : at + width])
            if window in seen:
                gone[at : at + width] = [True] * width
            seen.add(window)
        out[doc_id] = (own, gone)
    return out


def window_dedup(docs, width=20):
    rows = {}
    for doc_id, (own, gone) in repeats(docs, SPACED.findall, width).items():
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        rows[doc_id] = (len(own), sum(gone), sha(kept.encode()))
    return rows


def byte_dedup(docs, width=100):
    rows = {}
    for doc_id, (own, gone) in repeats(docs, lambda t: t.encode(), width).items():
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        rows[doc_id] = (len(own), sum(gone), spans, sha(bytes(b for b, g in zip(own, gone) if not g)))
    return rows


def decontaminate(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        own = LETTERED.findall((text or "").translate(LOWER))
        for at in range(max(1, len(own) - width + 1) if own else 0):
            windows[tuple(own[at : at + width])].add(str(item))
    sizes = {len(w) for w in windows}
    rows = {}
    for doc_id, text in docs:
        own = LETTERED.findall((text or "").translate(LOWER))
        hit, found = [False] * len(own), set()
        for size in sizes:
            for at in range(len(own) - size + 1):
                names = windows.get(tuple(own[at : at + size]))
                if names:
                    found |= names
                    hit[at : at + size] = [True] * size
        rows[doc_id] = (len(own), sum(hit), len(found), sha(",".join(sorted(found)).encode()), any(hit))
    return rows


def shingles(text, words):
    own = SPACED.findall((text or "").translate(LOWER))
    if not own:
        return set()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or {tuple(own)}


def near_duplicates(docs, words, percent=80):
    sets = {doc_id: shingles(text, words) for doc_id, text in docs}
    holders = defaultdict(list)
    shared = defaultdict(int)
    for doc_id, own in sets.items():
        for s in own:
            for other in holders[s]:
                shared[other, doc_id] += 1
            holders[s].append(doc_id)
    root = {doc_id: doc_id for doc_id in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def simhash(docs, radius=2):
    """doc_id -> fingerprint and smallest id reached; ids are distinct."""
    bits = {}
    for doc_id, text in docs:
        own = SPACED.findall((text or "").translate(LOWER))
        runs = [own[i : i + 3] for i in range(len(own) - 2)] or ([own] if own else [])
        found = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
        bits[doc_id] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in found) > len(found))
    root = {doc_id: doc_id for doc_id in bits}
    ids = sorted(bits)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[b] < root[a] and (bits[a] ^ bits[b]).bit_count() <= radius:
                    root[a], changed = root[b], True
    return {doc_id: (f"{bits[doc_id]:016x}", root[doc_id]) for doc_id in bits}


def prefix_trie(rows, tie):
    """Nodes from (conv_id, turn, role, text); ``tie`` orders the rows of one turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, *tie(role or "", text or "")), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(r)] for c, r in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        for depth in range(len(whole) + 1):
            nodes[whole[:depth]].append((c, len(whole) == depth))
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) if children[path] else 1
        here = (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        saved[path] = here + sum(saved[x] for x in children[path])
    return sorted(
        (
            min(nodes[p])[0],
            len(p),
            min(nodes[p[:-1]])[0] if p else -1,
            len(nodes[p]),
            len(children[p]),
            leaves[p],
            saved[p],
            sha(",".join(str(c) for c, end in sorted(nodes[p]) if end).encode()),
        )
        for p in nodes
    )
