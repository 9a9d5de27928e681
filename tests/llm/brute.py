"""Plain versions of the corpus operators, for small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from metrolith.llm import decontaminate, mixing

WORD = r"[^\x20\x09-\x0D]+"


def fingerprint(text):
    w = re.findall(WORD.encode(), (text or "").encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps):
    """The group of each fingerprint: links at 4 differing bits, all pairs."""
    values, parent = sorted(set(fps)), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in values}


def overlaps(docs, items):
    """{(place of the document, item id): most matching words}, over all diagonals; items of 12 words or more."""
    number, found = {}, {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of(t or "")], dtype=int)
    bench = [(i, ids(t)) for i, t in items]
    for place, text in enumerate(docs):
        doc = ids(text)
        for item, test in bench:
            x, y = np.nonzero(doc[:, None] == test)
            best = 0
            for d in np.flatnonzero(np.bincount(x - y + len(test), minlength=1) >= 12) - len(test):
                a, b = max(0, -d), min(len(test), len(doc) - d)
                c = np.concatenate([[0], np.cumsum(doc[d + a : d + b] == test[a:b])])
                best = max([best, *(c[e] - c[s] for s in range(len(c)) for e in range(s + 1, len(c)) if 4 * (c[e] - c[s]) >= 3 * (e - s))])
            if best >= 12:
                found[place, item] = int(best)
    return found


def schedule(sized):
    """(row, source's words, target, taken, copies) from the rows of ``mixing.sizes_of``; one bucket a source."""
    sizes = {}
    for r in sized:
        n, k = sizes.get(r["source"], (0, 0))
        sizes[r["source"]] = (n + r["size"], k + 1)
    plans = mixing.targets([(s, *x) for s, x in sizes.items()])
    asked = [p.target / p.block for p in plans]
    edges, seen, visits = np.cumsum(asked) / sum(asked), [0] * len(plans), Counter()
    for t in range(int(np.ceil(sum(asked)))):
        s = min(int(np.searchsorted(edges, (t + 1) * 0.6180339887498949 % 1.0, "right")), len(plans) - 1)
        blocks = -(-plans[s].size // plans[s].block)
        if seen[s] < 3 * blocks:
            visits[s, seen[s] % blocks] += 1
        seen[s] += 1
    out = []
    for s, p in enumerate(plans):
        at = 0
        for r in sorted((r for r in sized if r["source"] == p.source), key=lambda r: (r["h"], r["row_id"] or 0, r["h2"])):
            taken = sum(visits[s, w // p.block] for w in range(at, at + r["size"]))
            out.append((r, p.size, p.target, taken, visits[s, at // p.block] if r["size"] else 0))
            at += r["size"]
    return out


def tokens(rows, tokenizer, end_id=2):
    """(id, start, ids, crc) of (id, text) in the order of the files, each text encoded whole."""
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
