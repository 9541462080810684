"""Parts of Arrow batches, for functions whose results are larger than what they read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of a part, at most; a row that is larger is a part of its own.
PART_ROWS = 256
PART_BYTES = 4 << 20


def slices(batches: Iterable[tuple[pa.Array, ...]], rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of equal length, batch by batch, cut into parts without a copy: Spark bounds a batch by 10,000 rows and 64 MB, but Python objects made of one are many times that."""
    for b in batches:
        todo = [(a, min(rows, len(b[0]) - a)) for a in range(0, len(b[0]), rows)][::-1] or [(0, 0)]
        while todo:
            a, n = todo.pop()
            part = tuple(c.slice(a, n) for c in b)
            if n > 1 and sum(c.nbytes for c in part) > size:
                todo += [(a + n // 2, n - n // 2), (a, n // 2)]
            else:
                yield part
