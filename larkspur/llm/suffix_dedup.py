"""Exact removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of smaller key, or earlier in the same one.

The corpus is cut into shards by content, so equal strings meet:

1. Every window of ``length`` bytes belongs to one anchor: the k-gram of least
   hash in it.  Neighbouring windows of one anchor form a run.  Equal windows
   have equal anchors, so anchors are shuffled by their hash, and the runs of
   an anchor that occurs once are done.  A run whose whole context comes earlier
   in the same slice of texts is known as a repeat there; it is dealt by its own
   hash, so an anchor that fills a corpus doesn't fill one task.
2. A run whose whole context equals an earlier one is a repeat.  What is left,
   distinct contexts of one anchor, is cut from the texts and dealt into shards
   of at most a megabyte, an anchor with very many contexts into several.
3. Each shard gets a suffix array (Larsson-Sadakane: prefix doubling that sorts
   only groups that are not yet single) and Kasai's common prefixes; neighbours
   that share ``length`` bytes are one string, and its first place stays.
4. First places of an anchor that was dealt into several shards are merged by
   binary search among the sorted windows of all of them.

No group is collected: the shuffles by anchor and by window are streamed in
sorted order, and what is gathered per document is bounded by its length.

Null texts are empty; texts under ``length`` bytes lose nothing; an empty table
gives no rows.  Rows that repeat ``doc_id`` and text are one document given
twice: each gets its result, and they don't count as repeats of one another;
rows that repeat ``doc_id`` alone are ordered by a checksum of their texts.  A
null ``doc_id`` comes before all others.  Extra columns are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import RollingHash, concat_ranges, frugal, keyed, mixed, slices, utf8

LENGTH = 100
GRAM = 20
#: Bytes of text that a task hashes at once, and of contexts in one suffix array.
SLICE, SHARD = 500_000, 1_000_000
#: Contexts of one anchor that go to one shard.
SALT = 4096
RUN_BITS = 7

_one, _two = RollingHash(11), RollingHash(23)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value, leftmost of equals, in every window of ``width``."""
    n = len(v) - width + 1
    index = np.arange(len(v), dtype=np.uint64)
    key = (v & ~np.uint64((1 << 24) - 1)) | index
    pad = -len(v) % width
    key = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows by anchor: row, first position in its text, windows, anchor and context hashes."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return empty
    sums = _one.sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = mixed(_one.of(sums, at, at + gram))
    anchor = sliding_argmin(grams, length - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(anchor))
    valid = start + length <= offsets[row[: len(anchor)] + 1]
    start, anchor = start[valid], anchor[valid]
    if not len(start):
        return empty
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    p = start[first]
    n = np.diff(np.append(first, len(start)))
    a = anchor[first]
    context = _one.of(sums, p, p + n + (length - 1))
    context = mixed(context ^ mixed(((a - p) * 1024 + n).astype(np.uint64)))
    return row[p], p - offsets[row[p]], n, grams[a], context


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(h, c, d, tag, tp)`` of each run; ``tp`` packs position and number of windows."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        d, tag = batch.column("d").to_numpy(), batch.column("tag").to_numpy()
        for i, j in slices(offsets, SLICE):
            whole = data[offsets[i] : offsets[j]]
            own = offsets[i : j + 1] - offsets[i]
            for s in range(0, max(1, len(whole)), SLICE):  # one long text at a time is cut, with overlap
                part = whole if j - i > 1 else whole[s : s + SLICE + LENGTH - 1]
                row, p, n, h, c = runs_of(part, own if j - i > 1 else np.array([0, len(part)]))
                if len(row):
                    row = row + i
                    yield runs_batch(h, c, d[row], tag[row], ((p + s) << RUN_BITS) | n)
                if j - i > 1:
                    break


def runs_batch(h: np.ndarray, c: np.ndarray, d: np.ndarray, tag: np.ndarray, tp: np.ndarray) -> pa.RecordBatch:
    """Runs of one slice; ``known`` are those whose context comes earlier in it, in order of ``(d, tag, tp)``."""
    h, c = h.view(np.int64), c.view(np.int64)
    by = np.lexsort((h, c))
    first = np.append(True, (h[by][1:] != h[by][:-1]) | (c[by][1:] != c[by][:-1]))
    known = np.zeros(len(h), bool)
    if not first.all():
        group = np.cumsum(first) - 1
        shared = np.flatnonzero(np.bincount(group)[group] > 1)
        at, group = by[shared], group[shared]
        order = np.lexsort((tp[at], tag[at], d[at], group))
        at, group = at[order], group[order]
        # the least of each group, and what a document given twice repeats of it, aren't known
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(at[head], np.diff(np.append(head, len(at))))
        later = at[(d[at] != d[least]) | (tag[at] != tag[least]) | (tp[at] != tp[least])]
        known[later] = True
        h = h.copy()
        h[later] = mixed(mixed(d[later].view(np.uint64) ^ tag[later].view(np.uint64)) + tp[later].astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, d, tag, tp, known)], names=["h", "c", "d", "tag", "tp", "known"])


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``(h, c, d, tag, tp)`` to the runs that may repeat: ``ord`` is -1
    where the context has come before, else its number among the anchor's contexts.
    A run that comes again with the same ``(d, tag, tp)`` is of a document given twice.

    The state between batches is the row before and the first context of the
    current anchor, which counts only once a second one follows.
    """
    h0 = c0 = None
    before = None  # the row before
    held = None  # (h, d, tag, tp) of a first context so far alone
    count = 0

    def out(h, d, tag, tp, order):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, d, tag, tp, order)], names=["h", "d", "tag", "tp", "ord"])

    for batch in batches:
        known = np.flatnonzero(batch.column("known").to_numpy(zero_copy_only=False))
        if len(known):
            told = batch.take(pa.array(known))
            yield pa.RecordBatch.from_arrays([*(told.column(x) for x in ("h", "d", "tag", "tp")), pa.array(np.full(len(known), -1))], names=["h", "d", "tag", "tp", "ord"])
            batch = batch.filter(pc.invert(batch.column("known")))
        h, c, d, tag, tp = (batch.column(x).to_numpy() for x in ("h", "c", "d", "tag", "tp"))
        if not len(h):
            continue
        rows = np.array([h, c, d, tag, tp])
        new = np.append(True if before is None else (rows[:, 0] != before).any(), (rows[:, 1:] != rows[:, :-1]).any(axis=0))
        before = rows[:, -1]
        h, c, d, tag, tp = rows[:, new]
        if not len(h):
            continue
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c = new_h.copy()
        new_c[1:] |= c[1:] != c[:-1]
        if h0 is not None and h[0] == h0:
            new_h[0] = False
            new_c[0] = c[0] != c0
        group = np.cumsum(new_h)
        seen = np.cumsum(new_c)
        base = np.zeros(group[-1] + 1, np.int64)
        starts = np.flatnonzero(new_h)
        base[group[starts]] = seen[starts]
        base[0] = -(count - 1)  # the group that goes on has had `count` contexts
        order = seen - base[group]
        # a first context is kept if its group has another
        most = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(most, group, order)
        keep = ~new_c | (order > 0) | (most[group] > 0)
        extra = None
        if held is not None:
            if most[0] > 0 and group[0] == 0:
                extra = held
                held = None
            elif group[-1] > 0:
                held = None
        last = int(group[-1])
        tail = np.flatnonzero(new_c & (order == 0) & (group == last))
        if len(tail) and most[last] == 0:
            k = tail[0]
            held = (h[k], d[k], tag[k], tp[k])
            keep[k] = False
        keep = np.flatnonzero(keep)
        order = np.where(new_c, order, -1)
        count = int(order[group == last].max(initial=0)) + 1 if last else max(count, int(order.max(initial=-1)) + 1)
        h0, c0 = h[-1], c[-1]
        if extra is not None:
            yield out(*[np.array([x], np.int64) for x in (*extra, 0)])
        if len(keep):
            yield out(h[keep], d[keep], tag[keep], tp[keep], order[keep])


CUT = "k1 long, k2 long, kind int, d long, tag long, p long, e long, body binary"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the contexts that need a suffix array; merges the plain repeats of each text into ranges."""
    for batch in batches:
        text = batch.column("row").field("text")
        runs = batch.column("runs")
        where = np.flatnonzero(~np.asarray(runs.is_null()))
        if not len(where):
            continue
        rows: list[tuple] = []
        seen = set()
        size = 0
        for r in where:
            d, tag = batch.column("d")[r].as_py(), batch.column("tag")[r].as_py()
            if (d, tag) in seen:  # the document is given twice; the shards drop what other batches repeat
                continue
            seen.add((d, tag))
            data = (text[r].as_py() or "").encode()
            own = runs[r].values
            tp, h, order = (own.field(x).to_numpy() for x in ("tp", "h", "ord"))
            p = tp >> RUN_BITS
            n = tp & ((1 << RUN_BITS) - 1)
            plain = order < 0
            for s, e in zip(*merged(p[plain], p[plain] + n[plain] + LENGTH - 1), strict=True):
                rows.append((d ^ (s << 20), -1, 0, d, tag, s, e, None))
            for k in np.flatnonzero(~plain):
                s, o = int(p[k]), int(order[k])
                body = data[s : s + int(n[k]) + LENGTH - 1]
                rows.append((int(h[k]), o // SALT, 2, d, tag, s, 0, body))
                if o == SALT:  # tells the anchor's first shard that there are more
                    rows.append((int(h[k]), 0, 1, d, tag, 0, 0, None))
                size += len(body) + 60
            if size > 4_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["k1", "k2", "kind", "d", "tag", "p", "e", "body"],
    )


def merged(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Overlapping or touching ranges joined."""
    if not len(start):
        return [], []
    at = np.argsort(start, kind="stable")
    start, end = start[at], np.maximum.accumulate(end[at])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist()


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of at most 2^20 - 2 bytes by Larsson and Sadakane's refinement.

    A suffix's group number is the slot of its group's first member; a round
    sorts only the groups that are not single, by the group number ``h`` bytes
    further on, and doubles ``h``.
    """
    n, bits = len(data), 20
    mask = np.int64((1 << bits) - 1)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(4, np.int64)])  # the end is less than any byte
    key = np.zeros(n, np.int64)
    for k in range(4):
        key = (key << 9) | padded[k : k + n]
    packed = np.sort((key << bits) | np.arange(n))
    order = packed & mask
    head = np.ones(n, bool)
    head[1:] = (packed[1:] >> bits) != (packed[:-1] >> bits)
    slot = np.arange(n)
    group = np.zeros(n + 1, np.int64)
    group[order] = np.maximum.accumulate(np.where(head, slot, 0))
    alone = head & np.append(head[1:], True)
    active, h = np.flatnonzero(~alone), 4
    group += 1
    group[n] = 0
    while len(active):
        pos = order[active]
        after = group[np.minimum(pos + h, n)]
        packed = np.sort(((group[pos] - 1) << (2 * bits)) | (after << bits) | pos)
        order[active] = packed & mask
        head = np.ones(len(active), bool)
        head[1:] = (packed[1:] >> bits) != (packed[:-1] >> bits)
        group[order[active]] = np.maximum.accumulate(np.where(head, active, 0)) + 1
        active = active[~(head & np.append(head[1:], True))]
        h *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix and the one before it in ``order``.

    Kasai's scan, one lane for each context: the prefix at a position is at
    least the one before less one.
    """
    n = len(data)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before = np.where(slot > 0, order[slot - 1], n)
    padded = np.append(data, np.zeros(most + 1, np.uint8))
    lcp = np.zeros(n, np.int32)
    lanes = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[lanes], lengths[lanes]
    h = np.zeros(len(starts), np.int64)
    live = len(starts)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        while live and lengths[live - 1] <= t:
            live -= 1
        p = starts[:live] + t
        q = before[p]
        h = np.maximum(h[:live] - 1, 0)
        room = np.minimum(most, n - np.maximum(p, q))
        going = np.flatnonzero(h < room)
        while len(going):
            x = h[going]
            same = padded[p[going] + x] == padded[q[going] + x]
            going = going[same]
            h[going] += 1
            going = going[h[going] < room[going]]
        lcp[p] = h
    return lcp


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``(k1, k2, kind, d, tag, p)``, to ranges that go (kind 0) and, for anchors
    in several shards, first windows (kind 3, keyed by two hashes)."""
    pieces: list = []  # (d, tag, p, body, whether the anchor has other shards)
    size = 0
    key, split, own, own_size = None, False, [], 0

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        through = np.flatnonzero(kind == 0)
        if len(through):
            yield batch.take(pa.array(through))
        rest = np.flatnonzero(kind != 0)
        k1, k2, d, tag, p = (batch.column(x).to_numpy()[rest] for x in ("k1", "k2", "d", "tag", "p"))
        body = batch.column("body")
        for i, r in enumerate(rest):
            now = (k1[i], k2[i])
            if now != key:
                if size + own_size > SHARD and pieces:
                    yield from shard(pieces)
                    pieces, size = [], 0
                pieces += own
                size += own_size
                key, split, own, own_size = now, k2[i] > 0, [], 0
            if kind[r] == 1:
                split = True
            elif not own or own[-1][:3] != (d[i], tag[i], p[i]):
                b = body[r].as_py()
                own.append((d[i], tag[i], p[i], b, split))
                own_size += len(b)
    if size + own_size > SHARD and pieces:
        yield from shard(pieces)
        pieces = []
    if pieces + own:
        yield from shard(pieces + own)


def shard(pieces: list) -> Iterator[pa.RecordBatch]:
    # in order of document and position, so that the lowest position in a group is the first place
    d = np.array([x[0] for x in pieces], np.int64)
    tag = np.array([x[1] for x in pieces], np.int64)
    p = np.array([x[2] for x in pieces], np.int64)
    by = np.lexsort((p, tag, d))
    d, tag, p = d[by], tag[by], p[by]
    split = np.array([x[4] for x in pieces])[by]
    data = np.frombuffer(b"".join(pieces[i][3] for i in by), np.uint8)
    lengths = np.array([len(x[3]) for x in pieces], np.int64)[by]
    starts = np.cumsum(lengths) - lengths
    windows = lengths - (LENGTH - 1)
    order = suffix_array(data)
    lcp = kasai(data, order, starts, lengths, LENGTH)
    run = np.cumsum(lcp[order] < LENGTH)
    is_window = np.zeros(len(data), bool)
    at = concat_ranges(starts, windows)
    is_window[at] = True
    keep = is_window[order]
    place, run = order[keep], run[keep]
    head = np.ones(len(run), bool)
    head[1:] = run[1:] != run[:-1]
    least = np.minimum.reduceat(place, np.flatnonzero(head))
    repeat = np.zeros(len(data), bool)
    repeat[place] = True
    repeat[least] = False
    piece = np.repeat(np.arange(len(lengths)), windows)
    gone = repeat[at]
    a, w = at[gone], piece[gone]
    if len(a):
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1] + 1) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        s = p[w[first]] + (a[first] - starts[w[first]])
        e = p[w[first]] + (a[last] - starts[w[first]]) + LENGTH
        yield _ranges(d[w[first]], tag[w[first]], s, e)
    a, w = at[~gone & split[piece]], piece[~gone & split[piece]]
    if len(a):
        k1, k2 = (mixed(f.of(f.sums(data), a, a + LENGTH)) for f in (_one, _two))
        n = len(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.full(n, 3, np.int32)), pa.array(d[w]), pa.array(tag[w]), pa.array(p[w] + a - starts[w]), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())],
            names=["k1", "k2", "kind", "d", "tag", "p", "e", "body"],
        )


def _ranges(d: np.ndarray, tag: np.ndarray, p: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    n = len(d)
    return pa.RecordBatch.from_arrays(
        [pa.array(d ^ (p << 20)), pa.array(np.full(n, -1)), pa.array(np.zeros(n, np.int32)), pa.array(d), pa.array(tag), pa.array(p), pa.array(e), pa.nulls(n, pa.binary())],
        names=["k1", "k2", "kind", "d", "tag", "p", "e", "body"],
    )


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``(k1, k2, d, tag, p)``: of equal windows from several shards all but the first go."""
    last = None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        d, tag, p, e = (batch.column(x).to_numpy().copy() for x in ("d", "tag", "p", "e"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        gone = kind == 0
        w = np.flatnonzero(kind == 3)
        if len(w):
            a, b = k1[w], k2[w]
            # binary search for the first window of each key; a key's rows are neighbours
            left = np.searchsorted(a, a, "left")
            first = np.arange(len(w))
            new = np.ones(len(w), bool)
            new[1:] = b[1:] != b[:-1]
            new[left == first] = True
            if last == (a[0], b[0]):
                new[0] = False
            gone[w[~new]] = True
            e[w] = p[w] + LENGTH
            last = (a[-1], b[-1])
        gone = np.flatnonzero(gone)
        if len(gone):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[gone]) for x in (d, tag, p, e)],
                names=["d", "tag", "s", "e"],
            )


def remover(whole_characters: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans")
            text = row.field("text")
            has = ~np.asarray(spans.is_null())
            sizes, removed, runs, kept = [], [], [], []
            for i in range(len(batch)):
                data = (text[i].as_py() or "").encode()
                s, e = [], []
                if has[i]:
                    own = spans[i].values
                    s, e = merged(own.field("s").to_numpy(), own.field("e").to_numpy())
                sizes.append(len(data))
                removed.append(sum(e) - sum(s))
                runs.append(len(s))
                left = b"".join(data[x:y] for x, y in zip([0, *e], [*s, len(data)], strict=True))
                kept.append(left.decode(errors="ignore").encode() if whole_characters and s else left)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return remove


def suffix_dedup(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """Per row of ``docs``: ``row`` (the input row), ``n_bytes``, ``n_removed``, ``n_spans``
    and ``kept``, the bytes that stay; with ``whole_characters``, what is left of a
    code point that a removed span cuts in two is left out of ``kept``."""
    base = keyed(docs)
    found = (
        base.select("d", "tag", F.col("row.text").alias("text"))
        .mapInArrow(frugal(anchors), "h long, c long, d long, tag long, tp long, known boolean")
        .repartition("h")
        .sortWithinPartitions("h", "c", "d", "tag", "tp")
        .mapInArrow(frugal(resolve), "h long, d long, tag long, tp long, ord long")
    )
    # what is gathered for a document is bounded by its own length
    found = found.groupBy("d", "tag").agg(F.collect_list(F.struct("tp", "h", "ord")).alias("runs"))
    # both joins shuffle the same rows by the same key, so Spark makes that exchange once
    ranges = (
        base.join(found, ["d", "tag"], "left")
        .mapInArrow(frugal(cut), CUT)
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "kind", "d", "tag", "p")
        .mapInArrow(frugal(shards), CUT)
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "d", "tag", "p")
        .mapInArrow(frugal(merge), "d long, tag long, s long, e long")
        .groupBy("d", "tag")
        .agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    )
    schema = T.StructType(
        [T.StructField("row", docs.schema)]
        + [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept", T.BinaryType())]
    )
    return base.join(ranges, ["d", "tag"], "left").mapInArrow(frugal(remover(whole_characters)), schema)
