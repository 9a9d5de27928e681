"""Quality rules by repetition coverage.

Word ids of a text are rolled into hashes of several n-gram lengths in numpy.
For each length, the characters of the words inside n-grams that occur more than
once are measured against all characters in words; so are the characters of
lines that repeat an earlier line.  A document fails when a measure is above its
limit.  Base rules (too few words, too many repeated 3-word windows) come first
and can not be overruled.

Words are runs of anything but ASCII white space; lines are cut at ``\\n`` and
count only when they hold a word.  Hashes are 64 bits wide and a window is equal
to another when their hashes are; the base count compares word ids exactly.

Defined cases: null and empty texts have no words, fail the base rule and have
coverage zero; repeated rows each get a row; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import per_document

#: (n-gram length, largest share of characters inside repeated n-grams).  Shares
#: may be larger for shorter n-grams; a clean text repeats few long ones.
NGRAM_LIMITS = ((5, 0.30), (7, 0.25), (10, 0.20))
LINE_LIMIT = 0.30
SYMBOL_LIMIT = 0.05
MIN_WORDS = 50
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codepoints(raw: bytes) -> int:
    return len(raw.translate(None, _CONTINUED))


def _covered(keys: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words stand inside windows whose key occurs more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    edge = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of n ids, by doubling."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + len(out)]
            out ^= out >> np.uint64(31)
    return out


def measures(text: str, ngrams=NGRAM_LIMITS) -> dict:
    """The counts and coverages of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = _codepoints(raw.translate(None, SPACES))
    out = {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": len(raw.translate(None, _OTHER)),
        "n_dup_lines": 0,
        "n_repeat_words": 0,
        "dup_line_share": 0.0,
        "ngram_shares": [0.0] * len(ngrams),
    }
    seen, dup_chars = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                out["n_dup_lines"] += 1
                dup_chars += _codepoints(line.translate(None, SPACES))
            else:
                seen.add(line)
    out["dup_line_share"] = dup_chars / max(1, word_chars)
    if n < 3:
        return out
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    v = len(index)
    pairs = ids[:-1] * v + ids[1:]
    if v**3 < 2**62:
        triples = pairs[:-1] * v + ids[2:]
    else:
        _, pairs = np.unique(pairs, return_inverse=True)
        triples = pairs[:-1] * v + ids[2:]
    out["n_repeat_words"] = int(_covered(triples, 3, n).sum())
    if out["n_repeat_words"]:
        chars = np.fromiter(map(_codepoints, index), dtype=np.int64, count=v)[ids]
        for j, (size, _) in enumerate(ngrams):
            if n > size:
                inside = _covered(rolling(ids, size), size, n)
                out["ngram_shares"][j] = float(chars[inside].sum()) / max(1, word_chars)
    return out


def verdict(m: dict, ngrams=NGRAM_LIMITS) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    base_failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    repeats = any(s > limit for s, (_, limit) in zip(m["ngram_shares"], ngrams, strict=True))
    symbols = m["n_symbols"] > SYMBOL_LIMIT * max(1, m["word_chars"])
    return base_failed, not (base_failed or repeats or symbols or m["dup_line_share"] > LINE_LIMIT)


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, coverages and verdict of each document, without a shuffle."""

    def rows(texts):
        found = [measures(t) for t in texts]
        verdicts = [verdict(m) for m in found]
        longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {k: pa.array([m[k] for m in found], pa.int64()) for k in longs}
        out["base_failed"] = pa.array([b for b, _ in verdicts], pa.bool_())
        out["kept"] = pa.array([k for _, k in verdicts], pa.bool_())
        out["dup_line_share"] = pa.array([m["dup_line_share"] for m in found], pa.float64())
        for j, (size, _) in enumerate(NGRAM_LIMITS):
            out[f"dup_{size}gram_share"] = pa.array([m["ngram_shares"][j] for m in found], pa.float64())
        return out

    schema = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_share double"
    )
    schema += "".join(f", dup_{size}gram_share double" for size, _ in NGRAM_LIMITS)
    return per_document(docs, rows, schema, id_column, text_column)
