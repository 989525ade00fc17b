"""Group-wise processing of sorted Arrow streams in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def grouped(keys: int, body: Callable, largest: int):
    """Streams rows that are sorted by their first ``keys`` columns; ``body`` gets the rows of a group, ``largest`` at most."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            out = body(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            yield from ([out] if out is not None and out.num_rows else [])

        key, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, dtype=bool)
            for c in range(keys):
                v = batch.column(c).to_numpy(zero_copy_only=False)
                new[1:] = (new[1:] if c else False) | (v[1:] != v[:-1])
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                own = tuple(batch.column(c)[int(a)].as_py() for c in range(keys))
                if held and own != key:
                    yield from flush()
                    size = 0
                key = own
                while a < b:
                    n = int(min(b - a, largest - size))
                    held.append(batch.slice(int(a), n))
                    a, size = a + n, size + n
                    if size >= largest:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return run
