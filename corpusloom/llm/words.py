"""Words of a column of texts, numbered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text number and word number of every word `[^\\x20\\x09-\\x0D]+` in order, and the distinct words.

    bytes.split() parts at just these six characters."""
    lists = [t.split() for t in texts]
    held = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
    return np.repeat(np.arange(len(texts)), [len(x) for x in lists]), held.indices.to_numpy().astype(np.int64), held.dictionary.to_pylist()
