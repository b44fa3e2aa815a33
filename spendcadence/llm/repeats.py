"""Finding hashes that occur at more than one place, with one shuffle and no task that a hot hash could fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from spendcadence.llm.shingles import mixed


def travel_keys(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, travels, known) for the rows of a batch, which are ordered by hash and place.

    Rows of a hash's first place travel under the hash.  The others are spread by any key, as it is known
    already that they repeat; so is it for the first, if there are others.
    """
    new_hash = np.r_[True, hashes[1:] != hashes[:-1]]
    new_place = new_hash | np.r_[True, places[1:] != places[:-1]]
    starts, of_hash = np.flatnonzero(new_hash), np.cumsum(new_hash) - 1
    known = (np.add.reduceat(new_place.astype(np.int64), starts) > 1)[of_hash]
    travels = places == places[starts][of_hash]
    key = np.where(travels, hashes, mixed(places + np.arange(len(hashes), dtype=np.uint64)))
    return key, travels, known


def repeated_rows(key_col: str, known_col: str, places: Callable[[pa.RecordBatch], np.ndarray]):
    """Of rows that come ordered by key and place, those whose key has several places or is known to repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of a key that has not been seen to repeat yet
        last_key = last_place = None
        last_repeats = False
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            key, place = batch.column(names.index(key_col)).to_numpy(), places(batch)
            known = batch.column(names.index(known_col)).to_numpy(zero_copy_only=False)
            new = np.r_[key[0] != last_key, key[1:] != key[:-1]]
            group = np.cumsum(new) - new[0]
            repeats = known | np.r_[not new[0] and place[0] != last_place, (place[1:] != place[:-1]) & ~new[1:]]
            varied = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(varied, group, repeats)
            if new[0]:
                waiting = []
            elif varied[0] or last_repeats:
                varied[0] = True
                yield from waiting
                waiting = []
            yield batch.filter(pa.array(varied[group]))
            if group[-1] > 0:
                waiting = []
            if not varied[-1]:
                waiting.append(batch.filter(pa.array(group == group[-1])))
            last_key, last_place, last_repeats = key[-1], place[-1], bool(varied[-1])

    return work
