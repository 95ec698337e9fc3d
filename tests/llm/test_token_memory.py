"""Ids of a token file stand once in memory when they are read."""

import tracemalloc

import numpy as np
import pytest

from petrilens.llm import token_files


def test_a_file_is_read_block_by_block():
    n = 400_000
    data = token_files.file_bytes([1], [n], [np.arange(n, dtype=np.uint32) % 50_000], 1 << 14)
    tracemalloc.start()
    _, _, ids = token_files.read_file(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == n and ids[-1] == (n - 1) % 50_000
    assert peak < 13 * n  # 8 bytes an id, the words and a block; 16 and more with all blocks beside the whole
    with pytest.raises(ValueError, match="damaged"):
        token_files.read_file(data[:-16] + np.int64(n - 5).tobytes() + data[-8:])
