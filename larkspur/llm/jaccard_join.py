"""Similarity join of documents on the Jaccard coefficient of their word shingles.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct shingles of ``k`` words.  The join loses no link between different
texts, yet never expands a group of copies into pairs:

1. Documents of equal sets are one class; its least document stands for it.
2. Shingles are ordered rare first, by the number of documents that hold them
   (counted over all documents on a table of fixed size) and then by hash.  If
   two sets link, their prefixes of ``n - ceil(percent * n / 100) + l`` shingles
   share ``l`` or more; ``l`` is the smaller of ``1 + n // SHARE``.  Prefixes are
   shuffled by shingle.
3. Within a shingle's documents each is first paired with a hub, the one of the
   most common shingles that the length filter lets through.  Pairs that pass
   the positional filter and share half of ``l`` that way are verified, each
   once, behind a suffix filter.  Their components settle groups of near copies.
4. A pair of one component needs no test.  Shingles whose documents lie in more
   than one component are joined again, each document outside the shingle's
   largest component against those of other components, and pairs that share
   ``l`` shingles of their prefixes are verified likewise.  So each pair that can
   link is verified or already connected.  Before the join, each document that
   may still take part has those of its shingles counted that no other such
   document holds: they can't be shared, and most outliers of a group of near
   copies turn out unable to link with anything.  Shingles with the same largest
   component are joined in one place, in pieces of ``PIECE`` rows, so a pair of
   long documents is one row with a count and not a row for each shingle; a
   shingle of more than ``CELL`` documents is dealt into cells.  Pairs also pass a
   bitmap filter: signatures bound from below in how many shingles two sets differ.

Words are the runs of bytes other than ``\\x20 \\x09-\\x0D``, A-Z lower-cased.
A text of fewer than ``k`` words has its whole sequence as one shingle.  Null
texts and texts without words have empty sets and link with nothing; an empty
table gives no rows.  Rows that repeat ``doc_id`` and text are one document
given twice, and each gets its result; rows that repeat ``doc_id`` alone are
told apart by their texts.  A null ``doc_id`` sorts first.  Extra columns are
carried in ``row`` and can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import RollingHash, checkpointed, components, concat_ranges, frugal, keyed, mixed, slices, utf8, written

#: Counters of the frequency table: its size is fixed, so it can be broadcast.
SKETCH_BITS = 18
#: Bytes of text that a task hashes at once.
SLICE = 500_000
#: A pair shares one shingle of the prefixes, and one more for each so many of the smaller set.
SHARE = 20
#: Followers of a hub that are verified in one place, and targets listed in one row, about.
FOLLOWERS, TARGETS = 512, 1024
#: Words of 64 bits in a set's signature.
SIGNS = 8
#: Rows of one shingle that are held until its end is seen.
HELD = 50_000
#: Rows of torn shingles joined in one place, documents of one such shingle that meet there, and pairs made at once.
PIECE, CELL, AT_ONCE = 100_000, 20_000, 2_000_000
#: Pairs held before the filters.
BLOCK = 100_000
#: Components of more than one piece that may be broadcast.
MANY = 100_000

_words = RollingHash(37)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

Batches = Iterator[pa.RecordBatch]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and where each row's words begin and end among them."""
    word = ~_space[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    start = np.flatnonzero(word & (~before | bound[:-1]))
    end = np.flatnonzero(word & (~after | bound[1:])) + 1
    return mixed(_words.of(_words.sums(_lower[data]), start, end)), np.searchsorted(start, offsets)


def long_word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, in pieces that end at white space."""
    parts, i = [np.zeros(0, np.uint64)], 0
    while i < len(data):
        j = min(len(data), i + SLICE)
        while j < len(data) and not _space[data[j]]:
            near = np.flatnonzero(_space[data[j : j + SLICE]])
            j = j + int(near[0]) if len(near) else min(len(data), j + SLICE)
        parts.append(word_hashes(data[i:j], np.array([0, j - i]))[0])
        i = j
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted hashes of each row's distinct shingles."""
    words, rows = word_hashes(data, offsets) if len(data) <= SLICE else long_word_hashes(data)
    chain = words.copy()
    for t in range(1, k):
        chain = mixed(chain[: len(words) - t] * _ODD + words[t:]) if len(words) > t else chain[:0]
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(chain[a : b - k + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for t in range(a + 1, b):
                whole = mixed(whole * _ODD + words[t : t + 1])
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def sets_in(batch: pa.RecordBatch, k: int, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set, a slice of the batch's bytes at a time."""
    text = batch.column("text")
    rows = np.arange(len(batch)) if only is None else only
    data, offsets = utf8(text if only is None else text.take(pa.array(rows)))
    for i, j in slices(offsets, SLICE):
        for r, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k), i):
            yield int(rows[r]), s


def profiles(k: int) -> Callable[[Batches], Batches]:
    """Size, two order-free digests and a signature of each set.

    Bit ``b`` of the signature is the parity of the elements that fall on it, so
    two sets differ in at least as many elements as their signatures in bits.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n, s1, s2 = (np.zeros(len(batch), np.int64) for _ in range(3))
            signs = np.zeros((len(batch), SIGNS), np.uint64)
            for r, s in sets_in(batch, k):
                if len(s):
                    n[r] = len(s)
                    s1[r] = np.add.reduce(mixed(s)).view(np.int64)
                    s2[r] = np.bitwise_xor.reduce(mixed(s * _ODD)).view(np.int64)
                    odd = np.bincount((s >> np.uint64(64 - (64 * SIGNS).bit_length() + 1)).astype(np.int64), minlength=64 * SIGNS) & 1
                    signs[r] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("tag"), *map(pa.array, (n, s1, s2)), *(pa.array(signs[:, i].view(np.int64)) for i in range(SIGNS))],
                names=["d", "tag", "n", "s1", "s2", *(f"sign{i}" for i in range(SIGNS))],
            )

    return run


def frequencies(k: int) -> Callable[[Batches], Batches]:
    """How many sets hold a shingle of each counter, added up for the whole task."""

    def run(batches: Batches) -> Batches:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for _, s in sets_in(batch, k):
                held.append(s & np.uint64((1 << SKETCH_BITS) - 1))
            if held:
                count += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(count))
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["counter", "n"])

    return run


def prefixes(k: int, percent: int, sketch) -> Callable[[Batches], Batches]:
    """``(token, d, tag, n, pos, score)``: the rarest shingles of each set, with their places;
    ``score`` says how common its shingles are on the whole."""

    def run(batches: Batches) -> Batches:
        count = sketch.value
        for batch in batches:
            parts = []
            for r, s in sets_in(batch, k):
                n = len(s)
                if n:
                    p = n - (-(-percent * n // 100)) + 1 + n // SHARE
                    rarity = count[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                    if p < n:
                        near = np.argpartition(rarity, p - 1)
                        near = np.flatnonzero(rarity <= rarity[near[p - 1]])
                    else:
                        near = np.arange(n)
                    near = near[np.argsort(rarity[near], kind="stable")][:p]  # equals keep the order of hashes
                    parts.append((s[near], r, n, min(int(rarity.mean() * 100), 2**31 - 1)))
            if parts:
                lengths = [len(x[0]) for x in parts]
                row = np.repeat([x[1] for x in parts], lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)),
                        batch.column("d").take(pa.array(row)),
                        batch.column("tag").take(pa.array(row)),
                        pa.array(np.repeat([x[2] for x in parts], lengths).astype(np.int64)),
                        pa.array(np.concatenate([np.arange(x) for x in lengths]).astype(np.int32)),
                        pa.array(np.repeat([x[3] for x in parts], lengths).astype(np.int32)),
                    ],
                    names=["token", "d", "tag", "n", "pos", "score"],
                )

    return run


def hubs(percent: int) -> Callable[[Batches], Batches]:
    """Rows in order of ``token``, without tokens of one document, each with its hub.

    A token's documents are held until its end is seen; of more than ``HELD``
    the part seen is passed on, and the hubs found stay for the rest.
    """
    names = ["token", "d", "tag", "n", "pos"]

    def assign(heads: list[tuple], d: np.ndarray, tag: np.ndarray, n: np.ndarray, pos: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which of ``heads`` each row gets; new ones are added to it."""
        of = np.full(len(n), -1)
        k = 0
        while True:
            left = of < 0
            if k == len(heads):
                if not left.any():
                    return of
                i = int(np.argmax(np.where(left, score, -1)))
                heads.append((d[i], tag[i], n[i], pos[i]))
            hn = heads[k][2]
            of[left & (100 * n >= percent * hn) & (100 * hn >= percent * n)] = k
            k += 1

    def run(batches: Batches) -> Batches:
        held: pa.Table | None = None
        going: tuple | None = None  # token and hubs of a group of which a part is gone

        def groups(rows: pa.Table, whole: bool) -> Batches:
            """All groups but the last one, which is held unless it is large or the end is reached."""
            nonlocal going, held
            token, d, tag, n, pos, score = (rows.column(x).to_numpy() for x in (*names, "score"))
            n = n.astype(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
            last = len(cuts) - 2
            part = not whole and cuts[-1] - cuts[-2] > HELD
            held = None
            if not whole and not part:
                held, last = rows.slice(cuts[-2]), last - 1
            index, of, found = [], [], []
            for g in range(last + 1):
                i, j = int(cuts[g]), int(cuts[g + 1])
                heads = going[1] if going is not None and going[0] == token[i] else []
                if j - i > 1 or heads or (part and g == last):
                    own = assign(heads, *(x[i:j] for x in (d, tag, n, pos, score)))
                    index.append(np.arange(i, j))
                    of.append(own + len(found))
                    found += heads
                going = (token[i], heads) if part and g == last else None
            if index:
                out = rows.select(names).take(pa.array(np.concatenate(index))).combine_chunks().to_batches()[0]
                hd, ht, hn, hp = (np.array(x)[np.concatenate(of)] for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(hd.astype(np.int64)), pa.array(ht.astype(np.int64)), pa.array(hn.astype(np.int64)), pa.array(hp.astype(np.int32))],
                    names=[*names, "hd", "htag", "hn", "hpos"],
                )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if rows.num_rows:
                yield from groups(rows, False)
        if held is not None and held.num_rows:
            yield from groups(held, True)

    return run


def all_shingles(k: int) -> Callable[[Batches], Batches]:
    """``(token, d, tag)`` for every shingle of the given documents."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r, s in sets_in(batch, k):
                if len(s):
                    at = pa.array(np.full(len(s), r))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.view(np.int64)), batch.column("d").take(at), batch.column("tag").take(at)], names=["token", "d", "tag"]
                    )

    return run


def passes(percent: int, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Length and positional filters for a shared shingle at these places of two ordered sets."""
    # before the shared places at most min(pos) are common, from there on at most what is left of either
    return (
        (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb))
        & (F.lit(100 + percent) * (F.least(pa_, pb) + F.least(na - pa_, nb - pb)) >= F.lit(percent) * (na + nb))
    )


def least_shared(na: Column, nb: Column) -> Column:
    """Shingles of their prefixes that two sets must share to link."""
    return F.lit(1) + F.floor(F.least(na, nb) / F.lit(SHARE))


def ship(k: int) -> Callable[[Batches], Batches]:
    """The set of each document asked for, once for each place where it is verified."""
    names = ["hd", "htag", "salt", "role", "d", "tag", "body"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            targets = batch.column("targets")
            rows: list[list] = [[] for _ in names]
            size = 0
            for r, s in sets_in(batch, k):
                body = s.tobytes()
                d, tag = batch.column("d")[r].as_py(), batch.column("tag")[r].as_py()
                for t in targets[r].as_py():
                    for x, v in zip(rows, (t["hd"], t["htag"], t["salt"], t["role"], d, tag, body), strict=True):
                        x.append(v)
                    size += len(body) + 40
                if size > 8_000_000:
                    yield shipped(rows)
                    rows, size = [[] for _ in names], 0
            if rows[0]:
                yield shipped(rows)

    def shipped(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=names)

    return run


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Common elements of two sorted sets, or -1 if the suffix filter shows that there are too few."""
    if min(len(a), len(b)) < need:
        return -1
    mid = len(b) // 2
    cut = int(np.searchsorted(a, b[mid]))
    if min(cut, mid) + min(len(a) - cut, len(b) - mid) < need:
        return -1
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def verified(percent: int) -> Callable[[Batches], Batches]:
    """Rows in order of ``(hd, htag, salt, role)``, a hub before its followers, to the links."""

    def run(batches: Batches) -> Batches:
        key, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            keys = zip(*(batch.column(x).to_pylist() for x in ("hd", "htag", "salt", "role", "d", "tag")), strict=True)
            body = batch.column("body")
            for i, (hd, htag, salt, role, d, tag) in enumerate(keys):
                s = np.frombuffer(body[i].as_buffer(), np.uint64)
                if role == 0:
                    key, hub = (hd, htag, salt), s.copy()
                elif key == (hd, htag, salt):
                    need = -(-percent * (len(hub) + len(s)) // (100 + percent))
                    if overlap(hub, s, need) >= need:
                        out.append((hd, htag, d, tag))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                    names=["hd", "htag", "d", "tag"],
                )

    return run


def pairs_of(percent: int, piece: int, at_once: int) -> Callable[[Batches], Batches]:
    """Rows in order of ``(token, cell)`` within a piece, to pairs ``a < b`` of different components that pass
    the filters, with how many of the rows' shingles they share (``shared`` adds up over pieces)."""
    names = ["ad", "atag", "bd", "btag", "shared", "least"]

    def numbered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The place of each ``(x, y)`` among the distinct ones in order."""
        by = np.lexsort((y, x))
        new = np.append(True, (x[by][1:] != x[by][:-1]) | (y[by][1:] != y[by][:-1]))
        out = np.empty(len(x), np.int64)
        out[by] = np.cumsum(new) - 1
        return out

    def joined(rows: pa.Table) -> Batches:
        col = {x: rows.column(x).to_numpy() for x in rows.column_names if not x.startswith("sign")}
        me, inside = numbered(col["d"], col["tag"]), ~col["outside"]
        group = numbered(col["cd"], col["ctag"])
        n, pos, common = (col[x].astype(np.int64) for x in ("n", "pos", "common"))
        new = np.append(True, (col["token"][1:] != col["token"][:-1]) | (col["cell"][1:] != col["cell"][:-1]))
        cut = np.append(np.flatnonzero(new), len(me))
        size, begin = np.diff(cut)[np.cumsum(new) - 1], cut[np.cumsum(new) - 1]
        first = np.flatnonzero(col["xs"])
        if not len(first):
            return
        row_of = np.empty(len(me), np.int64)
        row_of[me] = np.arange(len(me))
        ends = np.cumsum(size[first])

        def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pairs of these rows that pass, each once, and how many rows they share."""
            i, j = np.repeat(x, size[x]), concat_ranges(begin[x], size[x])
            ok = col["ys"][j] & (group[i] != group[j]) & (inside[j] | (me[i] < me[j]))
            i, j = i[ok], j[ok]
            small, both = np.minimum(n[i], n[j]), n[i] + n[j]
            least_left = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (100 * small >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * least_left >= percent * both)
            ok &= (100 + percent) * np.minimum(common[i], common[j]) >= percent * both
            i, j = me[i[ok]], me[j[ok]]
            return np.unique(np.minimum(i, j) * len(me) + np.maximum(i, j), return_counts=True)

        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, "right")))
            blocks = np.split(first[lo:hi], np.flatnonzero(np.diff(ends[lo:hi] // BLOCK)) + 1)
            pairs, counts = (np.concatenate(v) for v in zip(*map(near, blocks), strict=True))
            pairs, at = np.unique(pairs, return_inverse=True)
            shared = np.bincount(at, counts, len(pairs)).astype(np.int64)
            i, j = row_of[pairs // len(me)], row_of[pairs % len(me)]
            apart = np.zeros(len(i), np.int64)
            for w in range(SIGNS):
                sign = rows.column(f"sign{w}").to_numpy()
                apart += np.bitwise_count((sign[i] ^ sign[j]).view(np.uint64))
            both = n[i] + n[j]
            ok = (100 + percent) * (both - apart) >= 2 * percent * both
            a, b, shared = i[ok], j[ok], shared[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (col["d"][a], col["tag"][a], col["d"][b], col["tag"][b], shared.astype(np.int64), 1 + np.minimum(n[a], n[b]) // SHARE)], names=names
                )
            lo = hi

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count > 2 * piece:
                rows = pa.Table.from_batches(held).combine_chunks()
                token, cell = rows.column("token").to_numpy(), rows.column("cell").to_numpy()
                last = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield from joined(rows.slice(0, end))
                held, count = rows.slice(end).to_batches(), len(token) - end
        if count:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return run


def torn_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(hd, htag, d, tag)`` of documents of different components that share as many of the torn
    shingles' rows as a link asks for."""
    c = F.col
    m = rows.groupBy("token").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    rows = rows.join(m, "token").withColumn("outside", c("component") != c("big"))
    # a shingle of S blocks of documents has S x S cells: those that are paired, by those that they are paired with
    own, blocks = F.pmod(F.hash("node"), c("cells")), F.sequence(F.lit(0), c("cells") - 1)
    cell = lambda at, xs, ys: F.struct(at.alias("cell"), xs.alias("xs"), ys.alias("ys"))
    across = F.transform(blocks, lambda j: cell(own * c("cells") + j, c("outside"), j == own))
    along = F.transform(blocks, lambda i: cell(i * c("cells") + own, F.lit(False), i != own))
    cells = F.filter(F.concat(across, along), lambda x: x["xs"] | x["ys"])
    rows = rows.select("*", F.explode(cells).alias("spot")).select("*", "spot.*")
    # the few components whose shingles fill more than one piece
    many = rows.groupBy("big").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).where("pieces > 1")
    many = checkpointed(many)
    many = F.broadcast(many) if many.count() <= MANY else many
    signs = [f"sign{i}" for i in range(SIGNS)]
    rows = rows.join(many, "big", "left").select(
        "token", "cell", F.pmod(F.xxhash64("token", "cell"), F.coalesce("pieces", F.lit(1))).alias("piece"), c("big.d").alias("bd"), c("big.tag").alias("btag"), "xs", "ys", "outside",
        c("node.d").alias("d"), c("node.tag").alias("tag"), c("component.d").alias("cd"), c("component.tag").alias("ctag"), "n", "pos", "common", *signs,
    )
    return (
        rows.repartition("bd", "btag", "piece")
        .sortWithinPartitions("bd", "btag", "piece", "token", "cell")
        .mapInArrow(frugal(pairs_of(percent, PIECE, AT_ONCE)), "ad long, atag long, bd long, btag long, shared long, least long")
        .groupBy(c("ad").alias("hd"), c("atag").alias("htag"), c("bd").alias("d"), c("btag").alias("tag"))
        .agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
        .where("shared >= least")
        .drop("shared", "least")
    )


LINKS = "hd long, htag long, d long, tag long"


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among distinct pairs ``(hd, htag, d, tag)``.

    A hub's followers are spread over as many places as their number asks for,
    and the hub's set goes to each of them.
    """
    many = pairs.groupBy("hd", "htag").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("places"))
    placed = pairs.join(many, ["hd", "htag"]).select(
        "hd", "htag", "d", "tag", F.pmod(F.hash("d", "tag"), F.col("places")).alias("salt")
    )
    asked = placed.select("d", "tag", F.struct("hd", "htag", "salt", F.lit(1).alias("role")).alias("t")).union(
        placed.select("hd", "htag", "salt").distinct().select(
            F.col("hd").alias("d"), F.col("htag").alias("tag"), F.struct("hd", "htag", "salt", F.lit(0).alias("role")).alias("t")
        )
    )
    lists = asked.groupBy("d", "tag").agg(F.ceil(F.count("*") / TARGETS).cast("int").alias("lists"))
    asked = asked.join(lists, ["d", "tag"]).groupBy("d", "tag", F.pmod(F.hash("t"), F.col("lists")).alias("part")).agg(F.collect_list("t").alias("targets"))
    return (
        texts.join(asked, ["d", "tag"])
        .mapInArrow(frugal(ship(k)), "hd long, htag long, salt int, role int, d long, tag long, body binary")
        .repartition("hd", "htag", "salt")
        .sortWithinPartitions("hd", "htag", "salt", "role")
        .mapInArrow(frugal(verified(percent)), LINKS)
    )


def node(d: str, tag: str) -> Column:
    return F.struct(F.col(d).alias("d"), F.col(tag).alias("tag"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(d, tag, n, cd, ctag)`` for each distinct document of at least one word: the size of
    its set and the least document that links reach from it."""
    spark = docs.sparkSession
    base = keyed(docs)
    texts = base.select("d", "tag", F.col("row.text").alias("text"))
    signs = [f"sign{i}" for i in range(SIGNS)]
    profile = checkpointed(texts.mapInArrow(frugal(profiles(k)), "d long, tag long, n long, s1 long, s2 long, " + ", ".join(f"{x} long" for x in signs)).where("n > 0").distinct())
    firsts = profile.groupBy("n", "s1", "s2").agg(F.min(node("d", "tag")).alias("first"))
    copies = profile.join(firsts, ["n", "s1", "s2"]).select("first", node("d", "tag").alias("own"))

    counted = (
        texts.mapInArrow(frugal(frequencies(k)), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    )  # at most 2^SKETCH_BITS rows
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    sketch = spark.sparkContext.broadcast(sketch)

    reps = firsts.select(F.col("first.d").alias("d"), F.col("first.tag").alias("tag"))
    live = written(
        texts.join(reps, ["d", "tag"])
        .mapInArrow(frugal(prefixes(k, percent, sketch)), "token long, d long, tag long, n long, pos int, score int")
        .repartition("token")
        .sortWithinPartitions("token", "d", "tag")
        .mapInArrow(frugal(hubs(percent)), "token long, d long, tag long, n long, pos int, hd long, htag long, hn long, hpos int")
    )
    c = F.col
    star = (
        live.where((c("d") != c("hd")) | (c("tag") != c("htag")))
        .where(passes(percent, c("n"), c("pos"), c("hn"), c("hpos")))
        .groupBy("hd", "htag", "d", "tag")
        .agg(F.count("*").alias("shared"), F.min(least_shared(c("n"), c("hn"))).alias("least"))
        .where("2 * shared >= least")
        .select("hd", "htag", "d", "tag")
    )
    links = checkpointed(verify(star, texts, k, percent))
    settled = components(links.select(node("hd", "htag").alias("a"), node("d", "tag").alias("b")))

    rows = live.select("token", "n", "pos", node("d", "tag").alias("node")).join(settled, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("m"))
    torn = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("big"), F.count("*").alias("parts"))
    torn = torn.where("parts > 1").select("token", F.col("big.component").alias("big"))
    rows = written(rows.join(torn, "token"))
    # who shares enough of its prefix to link with a set of the least size allowed
    own_n = F.first("n")
    enough = F.count("*") >= F.lit(1) + F.floor(F.ceil(F.lit(percent) * own_n / 100) / F.lit(SHARE))
    able = rows.groupBy("node").agg(own_n.alias("n"), enough.alias("enough")).where("enough")
    able = able.select("node", F.col("node.d").alias("d"), F.col("node.tag").alias("tag"))
    single = (
        texts.join(able.select("d", "tag"), ["d", "tag"])
        .mapInArrow(frugal(all_shingles(k)), "token long, d long, tag long")
        .groupBy("token")
        .agg(F.count("*").alias("m"), F.min("d").alias("d"), F.min("tag").alias("tag"))
        .where("m = 1")
        .groupBy("d", "tag")
        .agg(F.count("*").alias("alone"))
    )
    able = able.join(single, ["d", "tag"], "left").join(profile.select("d", "tag", *signs), ["d", "tag"])
    able = able.select("node", F.coalesce("alone", F.lit(0)).alias("alone"), *signs)
    rows = rows.join(able, "node").withColumn("common", F.col("n") - F.col("alone"))
    # of its own size n, a set links at best with one of ceil(percent * n / 100), and shares no more than `common`
    least_n = F.ceil(F.lit(percent) * F.col("n") / 100)
    rows = written(rows.where(F.lit(100 + percent) * F.col("common") >= F.lit(percent) * (F.col("n") + least_n)))
    rest = torn_pairs(rows, percent)
    tried = star.union(star.select("d", "tag", "hd", "htag"))
    rest = rest.join(tried, ["hd", "htag", "d", "tag"], "left_anti")
    more = verify(rest, texts, k, percent)

    edges = (
        links.union(more)
        .select(node("hd", "htag").alias("a"), node("d", "tag").alias("b"))
        .union(copies.select(F.col("first").alias("a"), F.col("own").alias("b")).where("a <> b"))
    )
    joined = components(edges)
    own = node("d", "tag")
    out = profile.withColumn("node", own).join(joined, "node", "left")
    group = F.coalesce("component", "node")
    return out.select("d", "tag", "n", group["d"].alias("cd"), group["tag"].alias("ctag"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``row``, ``n_shingles``, ``component_id`` (the least ``doc_id``
    that links reach; its own if none) and ``stays``, true for one document of each component."""
    found = jaccard_components(docs, k, percent)
    out = keyed(docs).join(found, ["d", "tag"], "left")
    own = F.coalesce("cd", "d")
    return out.select(
        "d",
        "tag",
        "row",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(own == -(1 << 63), F.col("row.doc_id").cast("long")).otherwise(own).alias("component_id"),
        ((own == F.col("d")) & (F.coalesce("ctag", "tag") == F.col("tag"))).alias("stays"),
    )
