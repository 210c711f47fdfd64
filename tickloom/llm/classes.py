"""Classes of words by their looks, and the discounts of modified Kneser-Ney counts."""
from __future__ import annotations

import numpy as np
import xxhash

BITS = 11
SYMBOLS = 1 << BITS
#: Symbols 0 to 15 are looks; then the beginning of a text; the rest are plain words.
BEGIN, PLAIN = 16, 17
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOP, _PAUSE = b".?!", b",;:"


def symbol(word: bytes) -> int:
    """Class of a word (UTF-8, no white space)."""
    core = word.strip(_PUNCT)
    tail = word[len(word.rstrip(_PUNCT)):]
    if tail == word:
        mark = 3
    elif not tail:
        mark = 0
    elif len(tail) == 1 and tail in _STOP:
        mark = 1
    elif len(tail) == 1 and tail in _PAUSE:
        mark = 2
    else:
        mark = 3
    text = core.decode("utf-8", "replace")
    if not text or not text.isalpha():
        shape = 3
    elif text.islower():
        shape = 0
    elif len(text) > 1 and text.isupper():
        shape = 2
    else:
        shape = 1
    if shape == 0 and mark == 0 and core == word:
        key = core if len(text) <= 3 else b"~" + text[-2:].encode()
        return PLAIN + xxhash.xxh64_intdigest(key) % (SYMBOLS - PLAIN)
    return shape * 4 + mark


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of counts 0, 1, 2 and 3 or more, from how many have count 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(d, 0.05 * k), float(k)) for k, d in enumerate(raw, 1)]])
