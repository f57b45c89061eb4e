"""Plain Python versions of the operators, one document after another."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WS = "[^\x20\x09-\x0D]+"


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def token_rows(docs, encode):
    """docs sorted by id; (doc_id, start, n_tokens, crc32)."""
    out, at = [], 0
    for doc_id, text in docs:
        ids = encode(text or "") + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def measures(text):
    text = text or ""
    w = re.findall(WS, text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), base)


def decontaminate(text, items):
    word = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, met = re.findall(word, fold(text)), set(), set()
    for item, t in items:
        if item is None:
            continue
        b = re.findall(word, fold(t))
        size = min(13, len(b))
        for i in range(len(b) - size + 1 if b else 0):
            for j in range(len(w) - size + 1):
                if w[j:j + size] == b[i:i + size]:
                    hit.update(range(j, j + size))
                    met.add(str(item))
    return (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w))


def fingerprint(text):
    w = re.findall(WS, fold(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(fps, max_bits=2):
    """Smallest index reachable from each index."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def removed(docs, match=50):
    """{row: (n_bytes, n_removed, n_spans, sha256)} for (doc_id, text) rows."""
    big = 1 << 62
    rows = [(big if d is None else d, (t or "").encode()) for d, t in docs]
    least = {}
    for d, b in rows:
        for k in range(len(b) - match + 1):
            s = b[k:k + match]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - match + 1):
            if least[b[k:k + match]] < d:
                gone[k:k + match] = [True] * match
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
