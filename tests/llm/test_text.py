"""Operators 2, 5 and 9."""

import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from larkspur.llm import licenses, quality, winnow
from larkspur.llm.queries import ORACLES, QUERIES
from tests.comparing import duck_rows, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op2_on_a_table(spark, sf_dir, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    ids = sorted(text, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = QUERIES["op2_winnowing"](spark, sf_dir).collect()
    assert len(rows) == len(text)
    prints = {}
    for r in rows:
        t = text[r.doc_id]
        m = len(t) // 3
        edited = t[: len(t) - m] + text[after[r.doc_id]][:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        hashes = lambda f: {x.split("@")[0] for x in f.split()}
        a, b = hashes(r.fingerprint), hashes(r.edited_fingerprint)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9


UNSPACED = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e3a\u0e40-\u0e5b]")


def winnowed(text):
    """(hash, position) by brute force: every window, the least of each WINDOW, rightmost of equals."""
    words = [x for w in WORD.findall(UNSPACED.sub(r" \g<0> ", text or "")) for x in ([w] if len(w) <= winnow.LONG else w)]
    if not words:
        return []
    if len(words) < winnow.GRAM:
        grams = [xxhash.xxh64(" ".join(words).encode(), 42).intdigest()]
    else:
        own = [xxhash.xxh64(w.encode(), 42).intdigest() for w in words]
        grams = []
        for i in range(len(words) - winnow.GRAM + 1):
            h = 42
            for x in own[i : i + winnow.GRAM]:
                h = xxhash.xxh64(x.to_bytes(8, "little"), h).intdigest()
            grams.append(h)
    keys = [(g >> 33, -i) for i, g in enumerate(grams)]
    n = len(keys)
    chosen = {min(keys[i : i + winnow.WINDOW]) for i in range(max(1, n - winnow.WINDOW + 1))}
    return sorted(((h, -i) for h, i in chosen), key=lambda x: x[1])


def test_op2_fingerprints_by_brute_force(spark, documents):
    han = "".join(chr(0x4E00 + i * 37 % 2000) for i in range(120))
    texts = ["", "one", "a b c d", "a b c d e f g h", "z " * 12, han, "prefix " + han[:40] + " and more words after it", "x" * 33 + " y", "é" * 80, "ab" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r.doc_id, r.text) for r in documents.where("doc_id < 60").collect()]
    got = {r.doc_id: r for r in winnow.winnow(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = {d: winnowed(t) for d, t in rows}
    order = sorted(plain, reverse=True)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        low = (1 << 31) - 1
        assert [(k >> 31, low - (k & low)) for k in got[d]["keys"]] == plain[d]
        a, b = ({h for h, _ in plain[x]} for x in (d, after))
        assert abs(got[d].near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    assert got[5].near_edited > 0.4  # a text without white space, two thirds of it as before


def test_winnowing_guarantee(spark):
    """A run of GRAM + WINDOW - 1 words that two texts share leaves them a common hash."""
    shared = " ".join(f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    df = spark.createDataFrame([(f"a b c d e f {shared} g h",), (f"k l m {shared} n o p q r",)], "text string")
    keys = [set(r[0]) for r in df.select(winnow.hashes(winnow.fingerprint(F.col("text")))).collect()]
    assert keys[0] & keys[1]


def test_rightmost_of_equals(spark):
    df = spark.createDataFrame([("z " * 12,)], "text string")  # all hashes are equal
    at = df.select(winnow.positions(winnow.fingerprint(F.col("text")))).first()[0]
    assert at == list(range(winnow.WINDOW - 1, 12 - winnow.GRAM + 1))


def test_op2_odd_rows(odd, none):
    rows = winnow.winnow(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert winnow.winnow(none).count() == 0


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_op5_on_a_table(spark, sf_dir, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    rows = QUERIES["op5_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = counted(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def test_op5_held_out_accuracy(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_rules"](spark, sf_dir).collect() if r.doc_id in labels and not r.base_failed]
    right = sum(r.kept == bool(labels[r.doc_id]) for r in rows)
    assert right >= 0.97 * len(rows)


def test_estimates_tell_a_bad_rule():
    """Votes made from known accuracies: the better rule gets the larger weight."""
    patterns = {(1, 1, 1): 700, (-1, -1, 1): 120, (-1, 1, 1): 30, (1, -1, 1): 50, (-1, -1, -1): 60, (1, 1, -1): 40}
    _, weights = quality.estimate(patterns)
    assert weights[0][-1] < weights[2][-1] < 0


def test_op5_odd_rows(odd, none):
    rows = quality.quality(odd, "doc_id", "text", "row").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.stats.n_words, r.stats.n_repeat_words) == (counted(r.text)[0], counted(r.text)[4])
    assert quality.quality(none, "doc_id").count() == 0
    assert quality.quality_filter(odd).columns == odd.columns


def test_op9_against_sql(spark, sf_dir):
    assert spark_rows(QUERIES["op9_license_scan"](spark, sf_dir)) == duck_rows(sf_dir, ORACLES["op9_license_scan"])


def test_op9_finds_each_template(spark):
    """Each template alone, and in the middle of a paragraph without line breaks."""
    every = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(2 * i + j, f"Some text before, {t} and after it" if j else t, n) for i, (n, t) in enumerate(every) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.dice
    same = {t: {n for n, x in every if licenses.normal_words(x) == licenses.normal_words(t)} for _, t in every}
    for i, text, n in rows:
        assert set(got[i]) <= same[every[i // 2][1]] and max(got[i].values()) == 1.0, (text, n, got[i])


def test_op9_edits_and_several_licences(spark):
    mit, isc = licenses.TEXTS["MIT"][0], licenses.TEXTS["ISC"][0]
    commented = "\n".join(" * " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    rows = [
        (1, commented), (2, mit.replace("Software", "Library")), (3, isc + "\n\nSome prose between them.\n\n" + "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (4, licenses.TEXTS["BSD-3-Clause"][0]), (5, licenses.TEXTS["BSD-2-Clause"][0]), (6, "// SPDX-License-Identifier: MIT\nint main() {}"), (7, "You need a licence to drive a car; permission is granted by the office."), (None, "MIT License " + mit),
    ]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {1: {"MIT"}, 2: {"MIT"}, 3: {"ISC", "CC-BY-4.0"}, 4: {"BSD-3-Clause"}, 5: {"BSD-2-Clause"}, 6: {"MIT"}, 7: {None}, None: {"MIT"}}


def test_op9_odd_rows(odd, none):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and {r.license for r in rows} == {None}
    assert licenses.scan_licenses(none).count() == 0
