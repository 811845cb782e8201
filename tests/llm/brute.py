"""The operators' results by plain loops."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import string
import zlib

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return _WORD.findall((text or "").translate(_FOLD))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(texts):
    sets = {}
    for doc, text in texts.items():
        w = words(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    shared = collections.Counter()
    lists = collections.defaultdict(list)
    for doc, own in sets.items():
        for shingle in own:
            shared.update((other, doc) for other in lists[shingle])
            lists[shingle].append(doc)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, links)
    return {doc: (len(own), found[doc]) for doc, own in sets.items()}


def repeats(texts, length=50):
    first, out = {}, {}
    for doc in sorted(texts):
        raw = (texts[doc] or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first.setdefault(raw[i : i + length], doc) < doc:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, gone in zip(raw, covered) if not gone)
        spans = sum(1 for i, gone in enumerate(covered) if gone and not (i and covered[i - 1]))
        out[doc] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_scores(texts):
    tokens = {doc: [*words(text), None] for doc, text in texts.items()}
    held = {doc: zlib.crc32(str(doc).encode()) % 7 == 2 for doc in texts}
    count = collections.Counter(w for doc, own in tokens.items() if not held[doc] for w in own)
    size, kinds = sum(count.values()), len(count)
    return {
        doc: (held[doc], len(own), sum(count[w] > 0 for w in own), size, sum(math.log10((count[w] + 1) / (size + kinds + 1)) for w in own))
        for doc, own in tokens.items()
    }


def bm25(texts, queries, k, k1=1.2, b=0.75):
    tf = {doc: collections.Counter(words(text)) for doc, text in texts.items()}
    length = {doc: sum(own.values()) for doc, own in tf.items()}
    mean, n = sum(length.values()) / len(tf), len(tf)
    df = collections.Counter(w for own in tf.values() for w in own)
    out = {}
    for query in queries:
        scores = {}
        for doc, own in tf.items():
            norm = k1 * (1 - b + b * length[doc] / mean)
            score = sum(q * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * (k1 + 1) / (own[w] + norm) for w, q in tf[query].items() if w in own)
            if score:
                scores[doc] = score
        out[query] = sorted(scores.items(), key=lambda item: (-round(item[1], 9), item[0]))[:k]
    return out
