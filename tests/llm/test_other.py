"""Operators 3, 4, 6, 7, 8 and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import chat, html_crf, mixing, packing, url_filter
from larkspur.llm.queries import ORACLES, QUERIES
from tests.comparing import duck_rows, spark_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_url_filter"])
def test_against_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, ORACLES[name])


def test_op3_round_trip(spark):
    texts = ["", "<|im_end|>\n", "<\\|im_end|>", "<<\\\\||", "a<|", "|>", "\\", "<", "x\n<|im_start|>user\ny<|im_end|>\n", None, "%0A%25"]
    rows = [(c, t, role, x) for c, role in ((1, "assistant"), (2, "us%er\n<|x"), (None, None)) for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(out) == 3
    for r in out:
        role = {1: "assistant", 2: "us%er\n<|x", None: ""}[r.conv_id]
        assert [tuple(t) for t in r.turns] == [(role, x or "") for x in texts]
    loss = chat.render(df).select("conv_id", chat.masked(chat.read_back(F.col("formatted"))).alias("v")).collect()
    assert {r.conv_id: r.v for r in loss} == {1: "".join(x or "" for x in texts), 2: "", None: ""}


def test_op3_folds_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"), (1, 4, 1, "regenerate", "assistant", "Hey"), (1, 5, 1, "delta", None, "!"),
        (1, 6, 0, "edit", "user", "hi there"), (1, 7, 2, "message", "user", "bye"), (1, 8, 2, "delete", None, None), (1, 9, 3, "delta", "user", "only"), (1, 10, 3, "delta", None, " deltas"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")
    got = sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(0, "user", "hi there"), (1, "assistant", "Hey!"), (3, "user", "only deltas")]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_op3_rows_that_tie(spark, sf_dir, tmp_path):
    """Tied, repeated and null turns, and rows without a conversation, against the SQL."""
    rows = [
        (1, 0, "user", "hi"), (1, 0, "assistant", "hey"), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, None, "assistant", "late"), (1, None, None, "later"), (1, None, None, None),
        (2, 3, None, "b"), (2, 3, "", "a"), (2, 3, "assistant", "c"), (None, 0, "user", "x"), (None, 0, "assistant", "y"), (None, None, "user", "z"), (3, 70, "user", "p"), (3, None, "user", "q"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "parts"))
    pq.write_table(pq.read_table(tmp_path / "parts"), tmp_path / "conversations.parquet")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.name != "conversations.parquet":
            (tmp_path / path.name).symlink_to(path)
    got = spark_rows(QUERIES["op3_chat_format"](spark, str(tmp_path)))
    assert got == duck_rows(str(tmp_path), ORACLES["op3_chat_format"])


def test_op3_deltas_after_ties(spark):
    log = [(1, 1, 0, "message", "a", "x"), (1, 1, 0, "message", "b", "y"), (1, 2, 0, "delta", "c", "!"), (1, None, 1, "message", "a", "p"), (1, 3, 1, "delta", None, "q")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, op string, role string, text string")
    assert sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect()) == [(0, "a", "x"), (0, "b", "y!"), (1, "a", "pq")]


def test_op4_rules(spark):
    urls = [None, "", "no scheme", "http://EN.Example.com/en/x?y", "http://www.example.com/en/", "http://example.com", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "x://b.com/#f", "x://b.com/#f"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(3, urls[3], 1)], "page_id long, url string, times int")
    from larkspur.llm.queries import URL_RULES

    rules = spark.createDataFrame([*URL_RULES, ("com", "/", "allow")], "host string, path string, verdict string")
    rows = url_filter.filter_urls(pages, rules).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("en.example.com", "/en/x", "example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5] == ("example.com", "", None, "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2] == "net/fr/" and got[8][2] is None and got[9][2] == "com/"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_op4_bloom_has_no_misses(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    blocks = 3000 * 16 // 512
    words = url_filter.bloom(keys, blocks)

    def hits(prefix):
        at, bits = url_filter.bits_of([f"{prefix}{i}" for i in range(3000)], blocks)
        return (words[at] & bits == bits).all(axis=1)

    assert hits("h").all() and hits("q").sum() < 150


def test_op4_long_urls(spark):
    """Very long paths and hosts of very many labels."""
    urls = ["http://" + "a." * 3000 + "net/es/" + "x" * 100_000, "http://example.com/" + "/" * 100_000, "x://" + "y" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    from larkspur.llm.queries import URL_RULES

    got = {r.page_id: (r.rule, len(r.path)) for r in url_filter.filter_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()}
    assert got == {0: ("net/es/", 100_004), 1: ("com/", 100_001), 2: (None, 0)}


@pytest.fixture(scope="module")
def model():
    return html_crf.trained()


def test_op6_held_out_blocks(model):
    right = total = 0
    for html, labels in html_crf.training_pages(150, seed=99):
        blocks = html_crf.leaf_blocks(html)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(model.decode(html_crf.features(blocks)), labels, strict=True))
        total += len(labels)
    assert right >= 0.96 * total


def test_op6_on_pages(spark, sf_dir, model):
    import html

    split = re.compile(r"</?(?:p|h1|h2|div|article|ul|li)\b[^>]*>")
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in split.split(inner))
        assert html_crf.main_text(p.html, model) == "\n\n".join(b for b in blocks if b)


def test_op6_odd_pages(spark, model):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "plain"), (4, "u", "<p>a <b>b<p>c &amp; &#233;\n d<br>e<script>x<y</script></article></p>"), (4, "u", "<!-- x"), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    rows = html_crf.extract(pages, model).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert [b.text for b in html_crf.leaf_blocks("<p>a <b>b<p>c &amp; &#233;\n d<br>e<script>x<y</script></article></p>")] == ["a b", "c & é d e"]
    assert html_crf.extract(pages.limit(0), model).count() == 0


def test_op6_viterbi_is_the_best_path(model):
    from itertools import product

    names = html_crf.features(html_crf.leaf_blocks(next(html_crf.training_pages(1, 5))[0]))[:9]
    scores = [sum(model.state.get(f, 0.0) for f in own) for own in names]

    def total(y):
        return model.begin[y[0]] + sum(s for s, t in zip(scores, y, strict=True) if t) + sum(model.moves[a][b] for a, b in zip(y, y[1:], strict=False))

    assert abs(total(model.decode(names)) - max(map(total, product((0, 1), repeat=len(names))))) < 1e-9


def test_op7_windows_and_lag():
    a = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 100)
    slots = mixing.edf(a)
    assert sorted(t for s in slots.values() for t in s) == list(range(100))
    for s, own in slots.items():
        for j, t in enumerate(own):
            assert j * 100 // a[s] <= t < -(-(j + 1) * 100 // a[s])
        for t in range(1, 101):
            assert abs(sum(x < t for x in own) - t * a[s] / 100) < 1


@pytest.mark.parametrize("weights", [{"a": 0.6180339887, "b": 0.2718281828, "c": 0.1101378285}, {f"s{i}": 1 + (i * 7919 % 97) / 31 for i in range(300)}])
def test_op7_real_weights(weights):
    """The whole schedule against the weights as given, and against a plain earliest-deadline-first run."""
    total = sum(weights.values())
    blocks = {s: max(1, round(20_000 * w / total)) for s, w in weights.items()}
    rows = mixing.schedule(weights, blocks)
    first = [r for r in rows if r["low"] == 0]
    period = first[0]["period"]
    rounds = -(-sum(blocks.values()) // period)
    slots = {r["source"]: [r["base"] + b // r["share"] * r["period"] + r["offsets"][b % r["share"]] for b in range(r["high"])] for r in first}
    assert len(slots) == len(weights)
    until = min(r["base"] + (r["high"] // r["share"]) * r["period"] for r in first)
    for s, own in slots.items():
        at = np.searchsorted(own, np.arange(1, until))
        assert np.abs(at - np.arange(1, until) * weights[s] / total).max(initial=0) < 1.001 + 0.5 * rounds
    a = mixing.shares({s: weights[s] for s in list(weights)[:5]}, 137)
    done, plain = dict.fromkeys(a, 0), {s: [] for s in a}
    for t in range(137):
        s = min((-(-(done[x] + 1) * 137 // a[x]), x) for x in a if done[x] < a[x] and done[x] * 137 // a[x] <= t)[1]
        plain[s].append(t)
        done[s] += 1
    assert mixing.edf(a) == plain


def test_op7_zero_weights_and_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * 40, f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, {"s0": 2.0, "s1": 0.0, "s2": 1.0}, block_chars=40).collect()
    assert len(rows) == 30 and min(r.slot for r in rows if r.source == "s1") > max(r.slot for r in rows if r.source != "s1")
    assert len(mixing.mix(docs, {"s0": 0.0, "s1": 0.0, "s2": 0.0}).collect()) == 30
    long = spark.createDataFrame([(1, "y" * 1000, "a"), (2, "z" * 10, "a"), (3, "w" * 500, "b")], "doc_id long, text string, source string")
    assert len({r.slot for r in mixing.mix(long, {"a": 1.0, "b": 1.0}, block_chars=20).collect()}) >= 2
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1.0})
    with pytest.raises(ValueError):
        mixing.mix(docs, most_sources=2)


def test_op7_on_a_table(spark, sf_dir, documents):
    weights = {f"src{i}": 1.0 + i for i in range(20)}
    rows = mixing.mix(documents, weights, block_chars=3000, period=210).collect()
    assert sorted(r.row.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    at = defaultdict(set)
    for r in rows:
        at[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in at.values())  # a slot holds one block
    place = {x: s for s, (x,) in at.items()}
    for (source, block), slot in place.items():
        assert all(place[source, b] < slot for b in range(block) if (source, b) in place)
    # while all sources last, each keeps within a block of its share
    a = mixing.shares(weights, 210)
    blocks = {s: max(b for x, b in place if x == s) + 1 for s in weights}
    until = min(n * 210 // a[s] for s, n in blocks.items())
    for s in weights:
        slots = sorted(v for (x, _), v in place.items() if x == s)
        empty = blocks[s] - len(slots)  # a document longer than a block leaves its later blocks unused
        assert all(abs(sum(v < t for v in slots) - t * a[s] / 210) < 1 + empty for t in range(1, until))


def test_op7_odd_rows(odd, none):
    rows = mixing.mix(odd, block_chars=50).collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"", "x", "y"}
    assert mixing.mixed_order(odd).columns == odd.columns and mixing.mixed_order(odd).count() == odd.count()
    assert mixing.mix(none).count() == 0


def check_packing(rows, texts):
    found = Tokenizer.from_file(WORDS).encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    encoded, pieces, bins = defaultdict(list), defaultdict(list), defaultdict(list)
    for (d, _), e in zip(texts, found, strict=True):
        encoded[d].append([*e.ids, packing.END])
    for r in rows:
        pieces[r.doc_id].append((r.doc_tokens, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(encoded)
    for d, own in pieces.items():
        assert sum(n for _, _, n, _ in own) == sum(map(len, encoded[d]))
        assert all(any(n == len(x) and crc == zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) for x in encoded[d]) for n, start, length, crc in own)
        for x in encoded[d]:  # of the text's pieces, each as often as the text, one run from 0 to its end
            spans = sorted({(start, length) for n, start, length, _ in own if n == len(x)})
            if len(encoded[d]) == 1:
                assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and len(spans) == len(own)
    padding = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.CAPACITY
        padding += packing.CAPACITY - at if at & (at - 1) else 0
    total = sum(len(x) for own in encoded.values() for x in own)
    assert padding <= packing.WASTE * total
    return padding / total


@pytest.mark.parametrize("capacity", [2048, 100, 7])
def test_op8_bins_by_class(capacity):
    rng = np.random.default_rng(capacity)
    bins, rows, docs = packing.Bins(capacity, 10), [], {}
    for d in range(400):
        docs[d] = rng.integers(0, 1 << 30, rng.integers(1, 3 * capacity)).astype("<u4")
        new = list(bins.put(d, docs[d]))
        by = defaultdict(list)
        for r in new:
            by[r[5]].append(r)
        for own in by.values():  # as many pieces as the class says, and little left
            total = sum(r[2] for r in own)
            assert total <= capacity and capacity - total <= packing.WASTE * capacity
            assert len(own) == 1 or all(r[2] <= -(-capacity // len(own)) + packing.WASTE * capacity for r in own)
        rows += new
    left = list(bins.rest())
    sizes = defaultdict(int)
    for r in left:
        sizes[r[5]] += r[2]
    assert all(n == capacity or n & (n - 1) == 0 for n in sizes.values())
    at = defaultdict(list)
    for d, start, n, _, tokens, _, _, body in rows + left:
        assert tokens == len(docs[d]) and body == docs[d][start : start + n].tobytes()
        at[d].append((start, n))
    for d, own in at.items():
        own.sort()
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == len(docs[d])
    assert sum(map(len, at.values())) < 5 * len(docs)


def test_op8_other_tokenizers(spark):
    """Tokenizers that see white space or case get whole texts."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain, words = Tokenizer.from_file(other), packing.WordCache(other)
    for t in ("Hello  World don't.\n\nA", "", " x", "中文 ABC"):
        assert words.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert not packing.WordCache(WORDS).whole and words.whole


def test_op8_on_a_table(spark, sf_dir, documents):
    check_packing(QUERIES["op8_packing"](spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_op8_odd_rows(odd, none):
    check_packing(packing.pack(odd, WORDS).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(none, WORDS).count() == 0


def test_op8_ids_are_the_tokenizers():
    import random

    rng = random.Random(1)
    letters = "aB é.'s,'tDn't lĺ'LLΣς2½_-*<>|#@~` \u3000中文İIﬁ\x0b\x1c\u0085\u200b9"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x<|endoftext|>y", "<|EndOfText|> A.", "ΑΣ. ΑΣ, ΣΑΣ'ς", "İ. don't. 'stop'stop,"]
    words = packing.WordCache(WORDS)
    for t in texts:
        assert words.encode(t).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, ids = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 2:
            assert docs.where("n_chars <> length(text)").count() == 0
    bad = [i for i in ids[0] if i in labels and labels[i].quality == 0]
    assert len(set(bad) & ids[1]) <= 0.1 * len(bad)
    assert ids[2] < ids[1] and ids[2] == ids[3] == ids[4] == ids[5]


def test_pipeline_runs_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_loss_digest_of_the_probe(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    r = QUERIES["op3_chat_format"](spark, sf_dir).where("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars) == (2, len(said))
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
