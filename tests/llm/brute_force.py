"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


@cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def encode(name, text, end):
    return library(name).encode(text or "", add_special_tokens=False).ids + end


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def contamination(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints):
    """Smallest id reachable, by (id, fingerprint) rows."""
    root = {f: f for _, f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    keys = list(root)
    for a in keys:
        for b in keys:
            if a != b and (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for i, f in prints:
        if i is not None:
            best[find(f)] = min(i, best.get(find(f), i))
    return sorted(((i, "%016x" % f, best.get(find(f))) for i, f in prints), key=str)


def top(vectors, k=5):
    """vectors: (id, list) rows."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in ok if j != i and len(u) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(set(out))


def base_marks(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def notice_marks(text, phrases, notices, alike):
    """Labels and score: every place where a notice may begin, one before the text's beginning too."""
    w, labels, best = words(text), set(), 0.0
    for p, label in phrases:
        p = p.split()
        if any(w[k : k + len(p)] == p for k in range(len(w))):
            labels.add(label)
            best = 1.0
    base = best
    for t, label, mandatory in notices:
        t = t.split()
        for s in range(-len(t), len(w)):
            got = [w[s + k] if 0 <= s + k < len(w) else None for k in range(len(t))]
            at = [next(k for k in range(len(t)) if t[k : k + len(m.split())] == m.split()) for m in mandatory]
            if all(got[k : k + len(m.split())] == m.split() for k, m in zip(at, mandatory)):
                share = sum(a == b for a, b in zip(got, t)) / len(t)
                best = max(best, share)
                labels |= {label} if share >= alike else set()
    return ",".join(sorted(labels)), 1.0 if base else best
