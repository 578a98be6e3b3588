"""Removal of repeated passages: every byte that a repeated string of SPAN bytes covers.

A full suffix array of the corpus is never built. Each window of SPAN bytes
names an anchor: the leftmost smallest hash among its GRAM-byte strings. Equal
windows name it at the same place, so only suffixes that begin at anchors, and
only against others with the same anchor, need an order. All windows that name
one anchor form its context; the window at distance o before the anchor is
repeated if and only if another occurrence agrees with o bytes on its left and
with SPAN - o on its right.

1. One pass finds anchors. Contexts that occur twice in a batch are repeated as a
   whole: their bytes are noted at once and one row goes on, so that a passage
   that stands in a third of all rows is not sent a third of all rows times.
2. Rows meet by anchor. Equal contexts (by a 128-bit digest of their bytes) are
   repeated as a whole; contexts that no other row has, in anchors that others
   have too, need their texts.
3. Those texts, with one of each repeated context beside them, form a shard per
   task. It is sorted by external induced sorting (suffixes.py), rightwards from
   the anchor and leftwards from it: texts lie in a file, suffix tuples pass
   through queues that spill sorted runs, common prefixes are carried along.
   Neighbours' common prefixes decide each window exactly.
4. An anchor that more than HOT different contexts share (a line that stands in
   a third of all rows, each time among other words) would make one task of many
   rows. It is lengthened: its windows are dealt into runs of neighbours, each
   named by the longer string that all windows of the run hold, and these go
   through steps 2 and 3 again. A run is PARTS times shorter each time; a run of
   one window is named by the window itself, so that the names end. No window is
   dropped or decided in another way.
5. Where passages are also judged by words, the strings of so many words that
   are shorter than SPAN bytes are counted by 128-bit hashes; longer ones are
   covered by windows of SPAN bytes.
6. The covered runs of a document are merged and cut out.

Null texts are empty; texts shorter than SPAN lose nothing. Matches never cross
documents; overlaps and repeats inside a document count. Rows that repeat a
whole row are copies of each other, so both lose all they have if it is SPAN
bytes or more. An empty table gives an empty one; other columns take no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remove, small_batches, written_at
from lodestone.llm.suffixes import BLOCK, IN_MEMORY, Strings, induce

SPAN, GRAM = 400, 32
SLICE = (1 << 20) - 2 * SPAN  # windows hashed at once; their places fit in 20 bits
PAIRWISE = 48
HOT = 1000  # different contexts of one anchor, above which it is lengthened
PARTS = 8  # the runs that an anchor's windows are dealt into each time
STRIDE = 8192  # window starts that are merged together
#: Per-document lists of up to so many rows with so many entries in all (at most 64 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_ENTRIES = 400_000, 2_000_000

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(77).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)
_IN_WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)], np.int8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Rolling hashes of the texts of one task; the tables of powers grow with the longest slice."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, None, None

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 15)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 2**64), self.n)
        return self.up, self.down

    def anchors(self, text: bytes, span: int = SPAN) -> tuple[np.ndarray, ...]:
        """Per anchor: its hash, its place, and the first and last window that name it."""
        parts = [self._slice(text, s, min(len(text) - span + 1, s + SLICE), span) for s in range(0, len(text) - span + 1, SLICE)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))

    def _slice(self, text: bytes, begin: int, end: int, span: int) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(text, np.uint8, end - begin + span - 1, begin)
        n, windows, wide = len(raw), end - begin, span - GRAM + 1
        up, down = self.tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64, out=sums[1:])
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # Hash above, place below: the smallest is the leftmost of equal hashes.
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        v = np.append(v, np.full(-len(h) % wide, 2**64 - 1, np.uint64)).reshape(-1, wide)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        named = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(named, prepend=-1))
        last = np.append(first[1:], windows) - 1
        at = named[first]
        return h[at], at + begin, first + begin, last + begin


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


_FOUND = "run boolean, k1 long, k2 long, h long, c1 long, c2 long, n int, at int, first int, last int"


def _context(text: bytes, at: int, first: int, last: int, span: int) -> bytes:
    """A digest of a context's bytes and of the anchor's place in them."""
    return xxhash.xxh3_128_digest(text[first : last + span] + (at - first).to_bytes(4, "big"))


def _met(span: int, k1, k2, row, h, digests: list[bytes], n, at, first, last) -> pa.RecordBatch:
    """Rows of anchors, one per context of the batch, and rows of runs that are known to be repeated."""
    c1, c2 = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2).T
    order = np.lexsort((c2, c1, h))
    same = np.append(False, (h[order][1:] == h[order][:-1]) & (c1[order][1:] == c1[order][:-1]) & (c2[order][1:] == c2[order][:-1]))
    heads = np.flatnonzero(~same)
    rows = np.diff(np.append(heads, len(order)))
    total = np.add.reduceat(n[order], heads)
    one = order[heads]
    repeated = order[np.repeat(rows, rows) > 1]
    runs = []
    by_row = repeated[np.argsort(row[repeated], kind="stable")]
    for r, mine in zip(*_groups(row[by_row], by_row), strict=True):
        a, b = merged(first[mine], last[mine] + span)
        runs.append((np.full(len(a), r), a, b))
    r_row, r_a, r_b = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 3
    m, q = len(one), len(r_a)
    zero = np.zeros(q, np.int64)
    both = lambda x, y, kind: pa.array(np.append(x, y).astype(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(m + q) >= m), both(k1[row[one]], k1[r_row], np.int64), both(k2[row[one]], k2[r_row], np.int64), both(h[one], zero, np.int64),
         both(c1[one], zero, np.int64), both(c2[one], zero, np.int64), both(total, zero, np.int32), both(at[one], zero, np.int32), both(first[one], r_a, np.int32), both(last[one], r_b, np.int32)],
        ["run", "k1", "k2", "h", "c1", "c2", "n", "at", "first", "last"],
    )


def _find(span: int, batches):
    """The anchors of whole texts."""
    hasher = Hasher()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [(i, *hasher.anchors(t, span)) for i, t in enumerate(texts) if t and len(t) >= span]
        if not found:
            continue
        row = np.concatenate([np.full(len(x[1]), x[0]) for x in found])
        h, at, first, last = (np.concatenate([x[k] for x in found]) for k in range(1, 5))
        digests = [_context(texts[i], *x, span) for i, *x in zip(row.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True)]
        k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        yield _met(span, k1, k2, row, h.view(np.int64), digests, np.ones(len(h), np.int64), at, first, last)


def _lengthen(span: int, width: int, batches):
    """The contexts of hot anchors as runs of at most `width` windows, named by what all windows of the run hold.

    Runs begin at the same distances before the anchor everywhere, so equal windows name equal strings.
    """
    most = span - GRAM
    for batch in batches:
        rows: list[tuple] = []
        digests: list[bytes] = []
        for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
            for w in wanted:
                at, low, high = w["at"], w["at"] - w["last"], w["at"] - w["first"]
                for part in range(low // width, high // width + 1):
                    near, far = part * width, min(part * width + width - 1, most)
                    name = xxhash.xxh3_64_intdigest(text[at - near : at - far + span], seed=(w["h"] + part) % 2**64)
                    first, last = at - min(far, high), at - max(near, low)
                    digests.append(_context(text, at, first, last, span))
                    rows.append((i, name, 1 if w["single"] else 2, at, first, last))
        if rows:
            row, h, n, at, first, last = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64), strict=True))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            yield _met(span, k1, k2, row, h.view(np.int64), digests, n, at, first, last)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.append(0, cuts)].tolist(), np.split(values, cuts)


def _contexts(span: int, batches):
    names = ["h", "single", "k1", "k2", "at", "first", "last", "bytes"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for text, k1, k2, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2", "wanted")), strict=True):
            for w in wanted:
                for c, v in zip(cols, (w["h"], w["single"], k1, k2, w["at"], w["first"], w["last"], text[w["first"] : w["last"] + span]), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def repeated_windows(order_r, common_r, order_l, common_l, low, high, span: int) -> np.ndarray:
    """Which distances o before the anchor are repeated, for the members of one group: members x (span + 1).

    order and common are one group's suffix order and common prefixes to the
    right of the anchor and to the left; low and high bound each member's o.
    """
    m = len(order_r)
    out = np.zeros((m, span + 2), np.int32)
    if m <= PAIRWISE:
        right, left = np.zeros((m, m), np.int64), np.zeros((m, m), np.int64)
        for order, common, shared in ((order_r, common_r, right), (order_l, common_l, left)):
            for p in range(m - 1):
                run = np.minimum.accumulate(common[p + 1 :])
                shared[order[p], order[p + 1 :]] = run
                shared[order[p + 1 :], order[p]] = run
        a = np.maximum(span - right, low[:, None])
        b = np.minimum(left, high[:, None])
        i, j = np.nonzero((a <= b) & ~np.eye(m, dtype=bool))
        np.add.at(out, (i, a[i, j]), 1)
        np.add.at(out, (i, b[i, j] + 1), -1)
        return np.cumsum(out, axis=1)[:, : span + 1] > 0
    for o in range(int(low.min()), int(high.max()) + 1):
        # Members in one class on both sides, and only they, share the window at o.
        r, left = np.empty(m, np.int64), np.empty(m, np.int64)
        r[order_r] = np.cumsum(common_r < span - o)
        left[order_l] = np.cumsum(common_l < o)
        here = np.flatnonzero((low <= o) & (o <= high))
        _, inverse, count = np.unique(r[here] * (m + 1) + left[here], return_inverse=True, return_counts=True)
        out[here, o] = count[inverse] > 1
    return out[:, : span + 1] > 0


def _decide(span: int, keep: int, batches):
    """Runs of repeated bytes of the single contexts of a shard. Its texts go to a file; per context a few numbers stay in memory."""
    store, parts = Strings(), []
    try:
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                store.add(data)
            parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "single", "k1", "k2", "at", "first", "last")])
        if not store.at:
            return
        store.open()
        h, single, k1, k2, at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, first, last = (x.astype(np.int64) for x in (at, first, last))
        group, begin = np.unique(h, return_inverse=True)[1], np.array(store.at, np.int64)
        cut, size = at - first, np.diff(np.append(begin, store.size))
        data, start, stop, middle = store.map, begin.tolist(), (begin + size).tolist(), (begin + cut).tolist()
        rightwards = lambda i, d: data[middle[i] + d * BLOCK : min(stop[i], middle[i] + (d + 1) * BLOCK)]
        leftwards = lambda i, d: data[max(start[i], middle[i] - (d + 1) * BLOCK) : middle[i] - d * BLOCK][::-1]
        orders = induce(group, size - cut, rightwards, keep), induce(group, cut, leftwards, keep)
        low, high = at - last, cut
        out: list[tuple] = []
        cuts = [np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)) for order, _ in orders]
        for (a, b), (c, d) in zip(*(zip(x, x[1:], strict=False) for x in cuts), strict=True):
            members = np.sort(orders[0][0][a:b])
            if len(members) < 2 or not single[members].any():
                continue
            local = [(np.searchsorted(members, order[i:j]), np.append(0, common[i + 1 : j])) for (order, common), (i, j) in zip(orders, ((a, b), (c, d)), strict=True)]
            hit = repeated_windows(*local[0], *local[1], low[members], high[members], span)
            for k in np.flatnonzero(single[members] & hit.any(axis=1)):
                i = members[k]
                o = np.flatnonzero(hit[k])[::-1]
                out += [(k1[i], k2[i], x, y) for x, y in zip(*merged(at[i] - o, at[i] - o + span), strict=True)]
            if len(out) >= 50_000:
                yield _runs(out)
                out = []
        yield _runs(out)
    finally:
        store.close()


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["k1", "k2", "first", "last"])


def _digest_words(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    edges = np.diff(_IN_WORD[np.frombuffer(text, np.uint8)], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


_SHORT = "w1 long, w2 long, n long, before long, after long, edge boolean, stop boolean, k1 long, k2 long, first int, last int"


def _short_strings(span: int, words: int, batches):
    """The strings of so many words that have fewer than span bytes, with a digest of the one a word before and after.

    Strings that stand more than once in a slice of a text are one row with their number n; as they are repeated whatever the
    other texts hold, the runs they cover are rows without digests. Next to such strings, and to those of another slice or
    STRIDE, is an edge, and a stop where it is the one after.
    """
    kinds = (*[pa.int64()] * 5, *[pa.bool_()] * 2, *[pa.int64()] * 2, *[pa.int32()] * 2)
    names = [c.split()[0] for c in _SHORT.split(", ")]
    for batch in batches:
        for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
            starts, ends = word_bounds(text)
            first, last = starts[: max(0, len(starts) - words + 1)], ends[words - 1 :]
            short = np.flatnonzero(last - first < span)
            for at in range(0, len(short), 20_000):
                ahead, n = int(at > 0), min(20_000, len(short) - at)
                near = short[at - ahead : at + n + 1]
                digests = [_digest_words(text[i:j]) for i, j in zip(first[near].tolist(), last[near].tolist(), strict=True)]
                _, lead, kind, times = np.unique(np.array(digests[ahead : ahead + n], np.int64), axis=0, return_index=True, return_inverse=True, return_counts=True)
                often = times[kind.ravel()] > 1
                follows = [False, *(np.diff(near) == 1).tolist(), False]  # whether near[i - 1] is a word before near[i]
                parts = (first[near] // STRIDE).tolist()
                apart = [*[True] * ahead, *often.tolist(), *[True] * (len(near) - ahead - n)]
                rows = []
                for i in range(ahead, ahead + n):
                    if not apart[i]:
                        back, on = follows[i], follows[i + 1]
                        stop = on and (apart[i + 1] or parts[i + 1] != parts[i])
                        edge = stop or (back and (apart[i - 1] or parts[i - 1] != parts[i]))
                        rows.append((*digests[i], 1, digests[i - 1][0] if back else None, digests[i + 1][0] if on else None, edge, stop, k1, k2, int(first[near[i]]), int(last[near[i]])))
                rows += [(*digests[ahead + i], int(m), None, None, False, False, k1, k2, 0, 0) for i, m in zip(lead.tolist(), times.tolist(), strict=True) if m > 1]
                here = short[at : at + n][often]
                rows += [(None, None, 0, None, None, False, False, k1, k2, int(x), int(y)) for x, y in zip(*merged(first[here], last[here]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _merge_part(batches):
    for batch in batches:
        rows = []
        for k1, k2, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "runs")), strict=True):
            runs = sorted((r["first"], r["last"], r["onward"]) for r in runs)
            first, last, onward = (np.array(x, np.int64) for x in zip(*runs, strict=True))
            # All strings from one that goes onward to the next row are repeated.
            last[:-1] = np.where(onward[:-1] == 1, np.maximum(last[:-1], last[1:]), last[:-1])
            rows += [(k1, k2, int(x), int(y)) for x, y in zip(*merged(first, last), strict=True)]
        yield _runs(rows)


def _short_runs(source: DataFrame, span: int, words: int, paths: list[str]) -> DataFrame:
    """Runs of repeated strings of so many words below span bytes. They are counted, never gathered; their join can be split.

    A repeated string that always follows the same string goes on from it, as that one is repeated too. One that
    has such a string on both sides never ends a run, so only the others leave the join: two rows for a passage that stands in
    many documents, and one more for each place where its copies part. Strings repeated within a text are summed there.
    """
    rows, path = written_at(source.mapInArrow(lambda b: _short_strings(span, words, b), _SHORT), "short-strings")
    paths.append(path)
    runs, rows = rows.where("w1 IS NULL").select("k1", "k2", "first", "last"), rows.where("w1 IS NOT NULL")
    same = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    counts = rows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), same("before").alias("backward"), same("after").alias("onward")).where("n > 1")
    counts = counts.select("w1", "w2", F.coalesce("backward", F.lit(False)).alias("backward"), F.coalesce("onward", F.lit(False)).alias("onward"))
    twice, path = written_at(counts, "short-strings-twice")
    paths.append(path)
    hits = rows.where("n = 1").join(twice, ["w1", "w2"]).where("edge OR NOT (backward AND onward)").withColumn("onward", F.expr("onward AND NOT stop"))
    parts = hits.groupBy("k1", "k2", F.floor(F.col("first") / STRIDE).alias("part")).agg(F.collect_list(F.struct("first", "last", "onward")).alias("runs"))
    return parts.mapInArrow(_merge_part, "k1 long, k2 long, first int, last int").unionByName(runs)


def _merge_runs(batches):
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            a, b = merged(np.array([r["first"] for r in runs], np.int64), np.array([r["last"] for r in runs], np.int64))
            out.append(np.stack([a, b], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, pa.list_(pa.int64()))], ["k1", "k2", "spans"])


def keyed(docs: DataFrame) -> DataFrame:
    """The documents' columns with text as bytes and a 128-bit key of text and doc_id."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("text", text).withColumns({"k1": F.xxhash64("text", F.lit(1)), "k2": F.xxhash64(F.lit(2), "doc_id", "text")})


def _beside(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """docs joined with per-document lists by key."""
    rows, entries = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and entries <= BROADCAST_ENTRIES:
        lists = F.broadcast(lists)
    return docs.join(lists, ["k1", "k2"], how)


def _shared_anchors(anchors: DataFrame, hot: int) -> tuple[DataFrame, str]:
    """Rows of anchors that stand twice: covered ones are repeated as a whole, needed ones are to be compared.

    Counts are summed map-side, written and joined back, so that no anchor's rows have to meet in one task: a join of
    two exchanges can be split where it is skewed, one with an aggregate cannot.
    """
    context = ["h", "c1", "c2"]
    shared, shared_at = written_at(anchors.groupBy("h").agg(F.sum("n").alias("of_anchor")).where("of_anchor > 1").select("h"), "anchors-twice")
    anchors, met_at = written_at(anchors.join(shared, "h", "left_semi"), "met-anchors")
    lead = F.struct("k1", "k2", "at")
    contexts, contexts_at = written_at(anchors.groupBy(*context).agg(F.sum("n").alias("of_context"), F.min(lead).alias("lead")), "anchor-contexts")
    per_anchor, per_anchor_at = written_at(contexts.groupBy("h").agg(F.min("of_context").alias("least"), F.count("*").alias("contexts")), "anchor-counts")
    marks, marks_at = written_at(contexts.join(per_anchor, "h").select(*context, "lead", (F.col("of_context") == 1).alias("single"), (F.col("least") == 1).alias("singles"), (F.col("contexts") > hot).alias("hot")), "anchor-marks")
    rows = anchors.join(marks, context)
    rows = rows.withColumn("covered", ~F.col("single") & (F.col("n") == 1)).withColumn("needed", F.col("singles") & (F.col("single") | (F.col("lead") == lead)))
    rows = rows.where("covered OR needed").select("k1", "k2", "h", "at", "first", "last", "single", "covered", "needed", "hot")
    out = written_at(rows, "shared-anchors")
    for path in (shared_at, met_at, contexts_at, per_anchor_at, marks_at):
        remove(path)
    return out


def repeated_spans(docs: DataFrame, span: int = SPAN, words: int | None = None, hot: int = HOT, keep: int = IN_MEMORY) -> DataFrame:
    """(k1, k2, spans) of each keyed() document that has repeated bytes: [start, end, start, end, ...] in its UTF-8 text.

    With words, a string of so many whole words counts as well, however short. Anchors of more than `hot` contexts are
    lengthened; a task's queues hold `keep` suffixes in memory.
    """
    small_batches(docs.sparkSession)
    source = docs.select("k1", "k2", "text")
    found, at = written_at(source.mapInArrow(lambda b: _find(span, b), _FOUND), "anchors")
    paths, width, runs = [at], span, []
    while True:
        runs.append(found.where("run").select("k1", "k2", "first", "last"))
        # A run of one window is named by the window, so its contexts are one.
        anchors, anchors_at = _shared_anchors(found.where("NOT run").drop("run"), hot if width > 1 else 2**31 - 1)
        runs.append(anchors.where("covered").select("k1", "k2", "first", (F.col("last") + span).alias("last")))
        lists = anchors.where("needed").groupBy("k1", "k2", "hot").agg(F.collect_list(F.struct("h", "single", "at", "first", "last")).alias("wanted"))
        wanted, wanted_at = written_at(lists, "wanted-contexts")
        schema = "h long, single boolean, k1 long, k2 long, at int, first int, last int, bytes binary"
        contexts = _beside(source, wanted.where("NOT hot").drop("hot"), "wanted", "inner").mapInArrow(lambda b: _contexts(span, b), schema)
        runs.append(contexts.repartition("h").mapInArrow(lambda b: _decide(span, keep, b), "k1 long, k2 long, first int, last int"))
        paths += [anchors_at, wanted_at]
        again = wanted.where("hot").drop("hot")
        if again.isEmpty():
            break
        width = -(-width // PARTS)
        longer = _beside(source, again, "wanted", "inner").mapInArrow(lambda b, w=width: _lengthen(span, w, b), _FOUND)
        found, at = written_at(longer, "longer-anchors")
        paths.append(at)
    if words:
        runs.append(_short_runs(source, span, words, paths))
    lists = reduce(DataFrame.unionByName, runs).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    spans, _ = written_at(lists.mapInArrow(_merge_runs, "k1 long, k2 long, spans array<long>"), "repeated-spans")
    for path in paths:
        remove(path)
    return spans


def kept_bytes(text: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return text
    edges = [0, *spans, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digest(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            kept = kept_bytes(text, spans)
            row = (len(text), len(text) - len(kept), len(spans or []) // 2, hashlib.sha256(kept).hexdigest(), kept_text(text, spans))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def with_spans(docs: DataFrame, span: int = SPAN, words: int | None = None, **options) -> DataFrame:
    """keyed() documents with the column spans, null where nothing is repeated."""
    rows = keyed(docs)
    return _beside(rows, repeated_spans(rows, span, words, **options), "spans", "left")


def removed_spans(docs: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that stays, in whole characters, per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_spans(docs.select("doc_id", "text"), span, **options)
    return rows.select("doc_id", "text", "spans").mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def kept_text(text: bytes, spans: list[int] | None) -> str:
    """What stays of a text, as characters: one that is removed in part only stays whole."""
    if not spans:
        return text.decode("utf-8", "replace")
    out = list(spans)
    for k in range(0, len(out), 2):
        a, b = out[k], out[k + 1]
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out[k], out[k + 1] = a, b
    return kept_bytes(text, out).decode("utf-8", "replace")


def op8_induced_spans(spark, sf_dir: str) -> DataFrame:
    return removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5_number(substr(h, 2 * s + 1, 800)) AS x FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM d)),
t AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
m AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN t USING (x)),
g AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM m),
i AS (SELECT r, g, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY r, g),
k AS (SELECT r, g, b AS a, lead(a) OVER (PARTITION BY r ORDER BY g) AS b FROM i UNION ALL SELECT r, 0, 0, min(a) FROM i GROUP BY r),
c AS (SELECT k.r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY g) AS h FROM k JOIN d USING (r) GROUP BY k.r),
-- whole characters: a run begins behind, and ends before, a character that it holds in part
e AS (SELECT i.r, g, a + (length(substr(h, 2 * a + 1, 6)) - length(regexp_replace(substr(h, 2 * a + 1, 6), '^([89AB].)+', ''))) // 2 AS a,
    b - CASE WHEN substr(h, 2 * b + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2 * b - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 2 * b - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS b FROM i JOIN d USING (r)),
l AS (SELECT r, g, b AS a, lead(a) OVER (PARTITION BY r ORDER BY g) AS b FROM e UNION ALL SELECT r, 0, 0, min(a) FROM e GROUP BY r),
o AS (SELECT l.r, decode(unhex(string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY g))) AS text FROM l JOIN d USING (r) GROUP BY l.r),
n AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM i GROUP BY r)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(c.h, d.h))) AS kept_sha256, coalesce(o.text, d.text, '') AS text
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN o USING (r)"""
