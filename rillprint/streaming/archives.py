"""Archives kept up to date by a stream of (archive_id, seq, op, chunk).

State of an archive is its stack of (length, hashes before the chunk), so that a remove restores what was before; events of a
batch are taken in the order of seq.  Every batch gives the archives it touched their new record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K
from ..spec import HashSpec

RECORD = "archive_id string, chunks long, length long, hash array<bigint>"
STATE = "lengths array<bigint>, before array<bigint>, hash array<bigint>"


class _Update:
    def __init__(self, spec: HashSpec):
        self.spec = spec

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spec, k = self.spec, self.spec.k
        lengths, before, now = (list(x) for x in state.get) if state.exists else ([], [], list(spec.zero))
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if row.op == "add":
                lengths.append(len(row.chunk))
                before += now
                now = [K.concat(h, K.hash_bytes(bytes(row.chunk), b, spec.prime), len(row.chunk), b, spec.prime) for h, b in zip(now, spec.bases)]
            elif row.op == "remove":
                if not lengths:
                    raise IndexError(f"a chunk is removed from the empty archive {key[0]}")
                lengths.pop()
                now, before = before[-k:], before[:-k]
            else:
                raise ValueError(f"unknown operation {row.op}")
        state.update((lengths, before, now))
        yield pd.DataFrame({"archive_id": [key[0]], "chunks": [len(lengths)], "length": [sum(lengths)], "hash": [now]})


def maintain(events: DataFrame, spec: HashSpec = HashSpec()) -> DataFrame:
    """RECORD of each archive that a batch touches; for update mode."""
    if not spec.is_long:
        raise ValueError("streams carry hashes as longs")
    return events.groupBy("archive_id").applyInPandasWithState(_Update(spec), RECORD, STATE, "update", GroupStateTimeout.NoTimeout)
