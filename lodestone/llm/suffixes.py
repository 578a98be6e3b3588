"""External induced sorting of sparse suffixes, with their longest common prefixes.

Strings lie in a file on disk. A string's order is induced from its first block
and the rank of what follows: the tails are sorted first, by recursion, then
tuples (group, head block, rank of the tail, string) go through a priority queue
that keeps a bounded part in memory and merges sorted runs from disk. Common
prefixes come along: two neighbours with equal heads share the head and the
smallest common prefix between their tails; others share what their heads share.
"""

from __future__ import annotations

import heapq
import mmap
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 64
IN_MEMORY = 20_000  # tuples of one queue; about 6 MB


class DiskQueue:
    """Tuples in, the same tuples out in ascending order. At most `keep` are in memory; the rest wait on disk as sorted runs."""

    def __init__(self, keep: int = IN_MEMORY):
        self.keep, self.buffer, self.runs = keep, [], []

    def push(self, item: tuple) -> None:
        self.buffer.append(item)
        if len(self.buffer) >= self.keep:
            self._spill()

    def _spill(self) -> None:
        self.buffer.sort()
        run = tempfile.TemporaryFile()
        for i in range(0, len(self.buffer), 4096):
            pickle.dump(self.buffer[i : i + 4096], run, pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        self.runs.append(run)
        self.buffer = []

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    part = pickle.load(run)  # noqa: S301  written by this process
                except EOFError:
                    return
                yield from part

    def drain(self) -> Iterator[tuple]:
        self.buffer.sort()
        if not self.runs:
            return iter(self.buffer)
        return heapq.merge(*(self._read(r) for r in self.runs), self.buffer)


class Strings:
    """Byte strings in a temporary file, read through a memory map; it goes with the object."""

    def __init__(self) -> None:
        self.file, self.at, self.size, self.map = tempfile.TemporaryFile(), [], 0, None

    def add(self, data: bytes) -> None:
        self.at.append(self.size)
        self.file.write(data)
        self.size += len(data)

    def open(self) -> None:
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), self.size, access=mmap.ACCESS_READ) if self.size else b""

    def close(self) -> None:
        if self.map:
            self.map.close()
        self.file.close()


def _heads_share(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Common prefix length of each pair of heads."""
    if not a:
        return np.empty(0, np.int64)
    pad = lambda xs: np.frombuffer(b"".join(x.ljust(BLOCK, b"\0") for x in xs), np.uint8).reshape(-1, BLOCK)
    differ = pad(a) != pad(b)
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
    return np.minimum(shared, np.minimum([len(x) for x in a], [len(x) for x in b]))


def induce(group: np.ndarray, length: np.ndarray, block, keep: int = IN_MEMORY, depth: int = 0, items: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their groups, and each one's common prefix with the one before it in its group.

    block(i, depth) gives string i's block at that depth. A queue holds `keep` tuples in memory.
    """
    items = np.arange(len(length)) if items is None else items
    tails = items[length[items] > (depth + 1) * BLOCK]
    rank, below = np.zeros(len(length), np.int64), np.zeros(1, np.int64)
    if len(tails):
        order, common = induce(group, length, block, keep, depth + 1, tails)
        rank[order] = np.arange(1, len(order) + 1)
        below = np.append(common, 0)
    queue = DiskQueue(keep)
    for i, g, r in zip(items.tolist(), group[items].tolist(), rank[items].tolist(), strict=True):
        queue.push((g, block(i, depth), r, i))
    order, common = np.empty(len(items), np.int64), np.zeros(len(items), np.int64)
    part: list[tuple] = []
    done = 0

    def settle(keep_last: bool) -> None:
        """Common prefixes of the tuples gathered so far; the last one stays to be the next one's neighbour."""
        nonlocal part, done
        first = 1 if done else 0
        order[done : done + len(part) - first] = [t[3] for t in part[first:]]
        g, r = np.array([t[0] for t in part]), np.array([t[2] for t in part])
        heads = [t[1] for t in part]
        pairs = np.flatnonzero(g[1:] == g[:-1])
        shared = _heads_share([heads[k] for k in pairs], [heads[k + 1] for k in pairs])
        deep = np.array([heads[k] == heads[k + 1] and len(heads[k]) == BLOCK for k in pairs], bool)
        deep &= (r[pairs] > 0) & (r[pairs + 1] > 0)
        if deep.any():
            at = np.stack([r[pairs[deep]], r[pairs[deep] + 1]], axis=1).ravel()
            shared[deep] += np.minimum.reduceat(below, at)[::2]
        common[done + pairs + 1 - first] = shared
        done += len(part) - first
        part = part[-1:] if keep_last else []

    for item in queue.drain():
        part.append(item)
        if len(part) > 65_536:
            settle(True)
    if len(part) > (1 if done else 0):
        settle(False)
    return order, common
