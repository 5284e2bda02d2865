"""Vectorised words, shingles and 64-bit hashes over the bytes of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: for matching of prose: ASCII letters and digits and every byte of a multi-byte character are word bytes; kana and Han characters are words of their own
WORDISH = np.zeros(256, bool)
WORDISH[48:58] = WORDISH[65:91] = WORDISH[97:123] = True
WORDISH[128:] = True
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_R, _RINV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _pows[k] = np.multiply.accumulate(x)
    return _pows[0], _pows[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters U+00C0 to U+00DE."""
    out = ASCII_LOWER[buf]
    if len(buf) > 1:
        up = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def lone_characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters that are words by themselves, as these scripts have no blanks: U+3041 to U+30FF, U+3400 to U+9FFF, U+F900 to U+FAFF, U+20000 to U+32FFF."""
    lead = np.flatnonzero(buf >= 0xE3)
    if not len(lead):
        return lead, lead
    b, nxt = buf[lead], buf[np.minimum(lead + 1, len(buf) - 1)]
    three = (b >= 0xE4) & (b <= 0xE9) | (b == 0xE3) & ((nxt >= 0x81) & (nxt <= 0x83) | (nxt >= 0x90)) | (b == 0xEF) & (nxt >= 0xA4) & (nxt <= 0xAB)
    four = (b == 0xF0) & (nxt >= 0xA0) & (nxt <= 0xB2)
    own = three | four
    return lead[own], np.minimum(lead[own] + 3 + four[own], len(buf))


def spans(is_word: np.ndarray, off: np.ndarray, alone: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that stay within a row, and first word of each row (n + 1). alone: starts and ends that part runs as well."""
    n = len(is_word)
    cut = off[(off > 0) & (off < n)]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    first[cut] = is_word[cut]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[cut - 1] = is_word[cut - 1]
    if alone is not None and len(alone[0]):
        a, z = alone
        first[a] = last[z - 1] = True
        z, a = z[z < n], a[a > 0]
        first[z] |= is_word[z]
        last[a - 1] |= is_word[a - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def span_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    p, q = _powers(len(folded) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum(_BYTES[folded] * p[: len(folded)], out=c[1:])
        h = (c[ends] - c[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, off: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the first word of each row (n + 1).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; loose: runs of letters and digits, Latin letters lower-cased, each kana or Han character a word.
    """
    folded = lower_latin(buf) if loose else ASCII_LOWER[buf]
    s, e, row = spans(WORDISH[buf], off, lone_characters(buf)) if loose else spans(~SPACE[buf], off)
    return span_hashes(folded, s, e), s, e, row


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row (rows are not told apart)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out + h[i : i + m]) * np.uint64(0x9FB21C651E98DF25 + 2 * i)
            out ^= out >> np.uint64(29)
    return mix(out)


def sets(h: np.ndarray, row: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row; a shorter row has its whole word sequence as one, an empty one none."""
    sh = shingles(h, k)
    out = []
    for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(sh[a : b - k + 1]))
        elif b > a:
            out.append(shingles(np.concatenate([h[a:b], np.full(k - (b - a), 0x5BF03635, np.uint64)]), k))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
