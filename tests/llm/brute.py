"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib

import numpy as np


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def topk(rows, k=5, every=50):
    fine = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for qi, q in fine:
        if qi % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != qi))[:k]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def suffix(rows, window=100):
    """(doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}; distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        hit = [False] * len(b)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                hit[i : i + window] = [True] * window
            else:
                seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[d] = (len(b), sum(hit), spans, sha(kept))
    return out


def decontam(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: word.findall((t or "").translate(lower))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    lens = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                x = tuple(w[k : k + n])
                if x in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def near(rows, width=3, percent=85):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    for d in ids:
        near = {e for s in sets[d] for e in by[s] if e > d}
        for e in near:
            both = len(sets[d] & sets[e])
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def crc(t):
    return zlib.crc32((t or "").encode())
