"""Operators 1 and 10 against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import jaccard_join as J
from larkspur.llm import suffix_dedup as S
from larkspur.llm.common import DROP_SHUFFLES, checkpointed, components, written
from larkspur.llm.jaccard_join import jaccard_join
from larkspur.llm.queries import QUERIES
from larkspur.llm.winnow import winnow

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeats(rows):
    """(id, text) in order of key, to (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op1_on_a_table(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r[0]: tuple(r[1:5]) for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()}
    assert [got[i] for i, _ in rows] == repeats(rows)


def test_op1_across_shards(documents, monkeypatch):
    monkeypatch.setattr(S, "SALT", 1)  # every context of an anchor in a shard of its own
    few = documents.where("doc_id < 60")
    rows = [tuple(r) for r in few.select("doc_id", "text").orderBy("doc_id").collect()]
    out = S.suffix_dedup(few).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    got = {r[0]: tuple(r[1:]) for r in out}
    assert [got[i] for i, _ in rows] == repeats(rows)


def test_op1_odd_rows(odd, none):
    out = S.suffix_dedup(odd).select("row.doc_id", "row.text", "row.row", "n_bytes", "n_removed").collect()
    assert len(out) == odd.count()
    by = {(r.doc_id, r.text): r for r in out}
    assert by[(1, None)].n_bytes == 0 and by[(5, by_text(odd, 5))].n_removed == 0
    assert all(r.n_removed == r.n_bytes for r in out if r.doc_id == 6)  # copies of 5
    assert by[(9, "é" * 300 + "x")].n_removed == 598  # all but the first two bytes, and the x at the end
    assert S.suffix_dedup(none).count() == 0


def test_op1_documents_given_twice(spark, monkeypatch):
    rng = random.Random(3)
    one, two, tail = (" ".join(f"{rng.randrange(10**9)}" for _ in range(n)) for n in (60, 80, 40))
    texts = [(1, one), (2, two + tail), (None, tail + two), (4, two[:500] + one + "x"), (5, "short")]
    order = sorted(texts, key=lambda r: -1 if r[0] is None else r[0])
    expected = dict(zip((i for i, _ in order), repeats(order), strict=True))
    for salt, times, size in ((4096, 2, 10000), (1, 2, 10000), (4096, 30, 2)):
        monkeypatch.setattr(S, "SALT", salt)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))  # so that copies lie in several batches
        out = S.suffix_dedup(spark.createDataFrame(texts * times, "doc_id long, text string")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(out) == len(texts) * times
        assert all(tuple(r[1:]) == expected[r[0]] for r in out)


def by_text(df, i):
    return df.where(F.col("doc_id") == i).first()["text"]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for alphabet, n in (("ab", 400), ("a", 300), ("abcdefgh", 1000), ("\0a", 200)):
        data = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        raw = np.frombuffer(data, np.uint8)
        order = S.suffix_array(raw)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        starts = np.array([0, n // 3]), np.array([n // 3, n - n // 3])
        lcp = S.kasai(raw, order, *starts, 50)
        slot = np.argsort(order)
        for p in range(n):
            q = order[slot[p] - 1] if slot[p] else n
            want = 0
            while q < n and want < 50 and p + want < n and q + want < n and data[p + want] == data[q + want]:
                want += 1
            assert lcp[p] == want


def shingles(text, k):
    words = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def linked(rows, k, percent):
    """Least id reached by links, by comparing every pair."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a1, b1 = find(i), find(j)
                root[max(a1, b1)] = min(a1, b1)
    return {i: (len(s), find(i)) for i, s in sets}


def test_op10_on_a_table(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard_join"](spark, sf_dir).collect()}
    assert got == linked(rows, 3, 90)


@pytest.mark.parametrize("cell, piece", [(J.CELL, J.PIECE), (7, 50)])
def test_op10_dense_group(spark, monkeypatch, cell, piece):
    """Near copies whose similarities lie around the threshold, so hubs alone don't settle them."""
    monkeypatch.setattr(J, "CELL", cell)  # a shingle's documents in cells, and its pairs in pieces
    monkeypatch.setattr(J, "PIECE", piece)
    monkeypatch.setattr(J, "AT_ONCE", 40 * piece)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join(df, k, percent).select(F.col("row.doc_id").alias("id"), "n_shingles", "component_id").collect()}
        assert got == linked(rows, k, percent)


def test_op10_odd_rows(odd, none):
    out = jaccard_join(odd, 3, 90).select("row.doc_id", "row.text", "row.tag", "n_shingles", "component_id", "stays").collect()
    assert len(out) == odd.count()
    assert {(r.n_shingles, r.component_id) for r in out if r.doc_id in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert {r.component_id for r in out if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in out if r.doc_id is None} == {None}
    assert sum(r.stays for r in out if r.doc_id in (5, 6)) == 1
    assert jaccard_join(none, 3, 90).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} or got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_op10_contained_sets_of_two_clusters(spark):
    """A link at the threshold between clusters whose rare shingles have hubs and largest components of either side."""
    common, one, two = ([f"{x}{i}" for i in range(n)] for x, n in (("c", 840), ("r", 30), ("s", 30)))
    extra, mine, yours = ([f"{x}{i}" for i in range(n)] for x, n in (("q", 100), ("m", 40), ("y", 20)))
    rows = [(1, common + one + two), (2, common + one + two + extra)]
    rows += [(10 + i, common + one + mine + [f"a{i}"]) for i in range(3)]  # link with 1 alone
    rows += [(20 + i, common + two + extra[:70] + yours + [f"b{i}"]) for i in range(3)]  # link with 2 alone
    rows += [(100 + i, mine + yours + [f"f{i}x{j}" for j in range(40)]) for i in range(40)]  # what makes those the hubs
    rows = [(i, " ".join(words)) for i, words in rows]
    expected = linked(rows, 1, 90)
    assert {expected[i][1] for i in (1, 2, 10, 20)} == {1} and len({c for _, c in linked(rows[1:], 1, 90).values()}) == 42
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join(df, 1, 90).select(F.col("row.doc_id").alias("id"), "n_shingles", "component_id").collect()}
    assert got == expected


def test_texts_of_one_id_with_like_checksums(spark):
    """Unlike texts without an id, whose CRC-32 agree in twenty bits."""
    rng = random.Random(8)
    seen = {}
    while True:
        one = " ".join(str(rng.randrange(10**9)) for _ in range(40))
        two = seen.setdefault(zlib.crc32(one.encode()) & 0xFFFFF, one)
        if one != two:
            break
    df = spark.createDataFrame([(None, one), (None, two), (None, two), (5, one)], "doc_id long, text string")
    out = jaccard_join(df).select("row.text", "n_shingles", "stays").collect()
    assert sorted((r.text, r.n_shingles) for r in out) == sorted([(one, 36), (two, 36), (two, 36), (one, 36)])
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted([one, two])
    cut = S.suffix_dedup(df).select("row.doc_id", "row.text", "n_removed").collect()
    assert {(r.doc_id, r.text): r.n_removed for r in cut} == {(None, one): 0, (None, two): 0, (5, one): len(one)}
    assert len(winnow(df).collect()) == 4


def test_tables_leave_no_shuffle_setting_behind(spark):
    before = spark.conf.get(DROP_SHUFFLES, None)
    counts = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    want = sorted(map(tuple, counts.collect()))
    for cut in (checkpointed, written):
        assert sorted(map(tuple, cut(counts).collect())) == want
        assert spark.conf.get(DROP_SHUFFLES, None) == before
    with pytest.raises(Exception, match="no such thing"):
        written(spark.range(1).selectExpr("raise_error('no such thing') AS x"))
    assert spark.conf.get(DROP_SHUFFLES, None) == before
    assert sorted(map(tuple, counts.collect())) == want  # its own shuffle is made again
