"""Plain, quadratic versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """rows: (doc_id, text). doc_id -> (keep_id, group_size, text_sha256)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    return {
        doc_id: (min(members)[1], len(members), sha(key))
        for key, members in groups.items()
        for _, doc_id in members
    }


def substrings(rows, window=20):
    """doc_id -> (n_words, n_removed, kept words joined)."""
    words = {doc_id: WORD.findall(text or "") for doc_id, text in rows}
    first = {}
    for doc_id in sorted(words):
        for i in range(len(words[doc_id]) - window + 1):
            first.setdefault(tuple(words[doc_id][i : i + window]), (doc_id, i))
    found = {}
    for doc_id, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (doc_id, i):
                gone.update(range(i, i + window))
        found[doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return found


def shingles(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    pairs = {(a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
