"""Word shingles of whole texts as sets of 64-bit numbers, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower case) and the bounds of each text among them."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(clean))
    coded = cut.values.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    bounds = cut.offsets.to_numpy()
    found = each[coded.indices.to_numpy()] if len(each) else each
    blank = xxhash.xxh3_64_intdigest("")
    if len(found) and (found == blank).any():  # an empty text is split into one empty word
        keep = found != blank
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        found = found[keep]
    return found, bounds


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of each text. A text of fewer words has one shingle of them all, one without words none."""
    hashes, bounds = word_hashes(texts)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled = (rolled ^ hashes[k : len(hashes) - words + 1 + k]) * step if len(rolled) else rolled
            rolled ^= rolled >> np.uint64(29)
    out = []
    for a, b in zip(bounds.tolist(), bounds.tolist()[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
