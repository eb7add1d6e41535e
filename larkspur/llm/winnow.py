"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's tokens are its words; a word of a script written without spaces, or of
more than ``LONG`` characters, is a token for each of its characters, so texts
without white space have windows too.  Every window of ``GRAM`` tokens is
hashed; of each ``WINDOW`` neighbouring hashes the least is chosen, the rightmost of equals, and kept with its position.  So
any run of ``GRAM + WINDOW - 1`` tokens that two texts share leaves them a common
hash, and equal texts have equal fingerprints.  A hash and its position are one
long, ``hash << 31 | (2^31 - 1 - position)``, so that ``least`` picks by hash
and then by the later position.

A window's hash is made from its tokens' hashes, each of which is computed once:
array functions have no running state from which a hash could be rolled in
linear time.

Texts of fewer than ``GRAM`` tokens have their whole sequence as one window; a
text without words, or null, has the empty fingerprint.  Likeness is the Jaccard
coefficient of the hashes; of two empty fingerprints it is 1, of one it is 0.
Rows that repeat ``doc_id`` come one after another, by a checksum of the text;
a null ``doc_id`` is the least.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import MIN_LONG, checkpointed, keyed
from larkspur.llm.quality import grams_of, let, words_of

GRAM, WINDOW = 5, 4
#: Words of more characters, and scripts written without spaces, are taken by character.
LONG = 32
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_LOW = (1 << 31) - 1
#: Documents in one bucket of the order by ``doc_id``, about.
BUCKET = 20_000
#: Beyond this many buckets they grow instead.
MOST_BUCKETS = 2000


def tokens_of(text: Column) -> Column:
    """Words, and the characters of those that white space doesn't divide."""
    wide = (F.length(text) < F.octet_length(text)) & text.rlike(UNSPACED)
    spaced = F.when(wide, F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)

    def divided(words: Column) -> Column:
        letters = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.array_remove(F.split(w, ""), "")).otherwise(F.array(w))))
        return F.when(F.exists(words, lambda w: F.length(w) > LONG), letters).otherwise(words)

    return let(words_of(spaced), divided)


def fingerprint(text: Column) -> Column:
    """Chosen hashes with their positions, each packed in a long, in text order."""

    def choose(words: Column) -> Column:
        whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
        grams = F.when(F.size(words) >= GRAM, grams_of(words, GRAM)).otherwise(whole)
        packed = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 31).bitwiseOR(F.lit(_LOW).cast("long") - i))
        return let(packed, least_of)

    def least_of(keys: Column) -> Column:
        few = F.when(F.size(keys) > 0, F.array(F.array_min(keys))).otherwise(keys)
        window = lambda x, i: F.least(x, *[F.get(keys, i + j) for j in range(1, WINDOW)])
        many = F.transform(F.slice(keys, 1, F.greatest(F.size(keys) - (WINDOW - 1), F.lit(0))), window)
        return F.when(F.size(keys) < WINDOW, few).otherwise(F.array_distinct(many))

    return let(tokens_of(text), choose)


def hashes(keys: Column) -> Column:
    """The distinct hashes, of 31 bits each."""
    return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, 31).cast("int")))


def positions(keys: Column) -> Column:
    """Where the chosen windows begin, counted in tokens from 0."""
    return F.transform(keys, lambda k: (F.lit(_LOW).cast("long") - k.bitwiseAND(F.lit(_LOW).cast("long"))).cast("int"))


def written(keys: Column) -> Column:
    """The fingerprint as text: ``hash@position`` in hexadecimal and decimal."""
    low = F.lit(_LOW).cast("long")
    return F.array_join(F.transform(keys, lambda k: F.concat(F.hex(F.shiftright(k, 31)), F.lit("@"), low - k.bitwiseAND(low))), " ")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def neighbours(ids: DataFrame, count: int) -> DataFrame:
    """``(d, tag, next_d, next_tag, next_chars, prev_d, prev_tag, prev_chars)`` in the circular order of
    descending ``(d, tag)``, of rows ``(d, tag, n_chars)``.

    Ids are cut into buckets at quantiles, so no task orders them all; only the
    last row of each bucket looks past it, to the first of the next.
    """
    parts = min(MOST_BUCKETS, max(1, -(-count // BUCKET)))
    cuts = ids.agg(F.percentile_approx("d", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 100).alias("q"))
    cuts = sorted(set(cuts.first()["q"] or []))  # one value a bucket
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("d"))) if cuts else F.lit(0)
    rows = ids.withColumn("bucket", bucket).withColumn("me", F.struct("d", "tag", "n_chars"))
    by = Window.partitionBy("bucket").orderBy(F.desc("d"), F.desc("tag"))
    near = rows.select("bucket", "me", F.lead("me").over(by).alias("next"), F.lag("me").over(by).alias("prev"))
    ends = rows.groupBy("bucket").agg(F.max("me").alias("top"), F.min("me").alias("bottom"))
    around = Window.orderBy(F.desc("bucket"))  # one row a bucket
    ends = ends.select(
        "bucket",
        F.coalesce(F.lead("top").over(around), F.max("top").over(around)).alias("after"),
        F.coalesce(F.lag("bottom").over(around), F.min("bottom").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ahead"),
    )
    return near.join(ends, "bucket").select(
        "me.*", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "ahead").alias("prev")
    )


def winnow(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_chars``, ``edited`` (its end replaced by the beginning of the next
    document), the fingerprints of both as packed arrays, and their likenesses.

    Texts are shuffled once, by key; Spark takes the same exchange for both sides
    of the join.  A document hands the one before it as much of its beginning as
    that one drops, and its hashes.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    base = keyed(docs).select("d", "tag", text.alias("text"))
    length = F.length("text").cast("long")
    ids = checkpointed(base.groupBy("d", "tag").agg(F.max(length).alias("n_chars"), F.count("*").alias("times")))
    total, once = ids.agg(F.count("*"), F.count(F.when(F.col("times") == 1, 1))).first()
    near = neighbours(ids.drop("times"), total).select("d", "tag", "prev")
    given = base.join(near, ["d", "tag"]).select(
        F.col("prev.d").alias("d"), F.col("prev.tag").alias("tag"),
        F.expr("substring(text, 1, cast(prev.n_chars div 3 as int))").alias("head"), hashes(fingerprint(F.col("text"))).alias("next_hashes"),
    )
    if once < total:  # a document given twice hands on once
        given = given.dropDuplicates(["d", "tag"])
    both = base.join(given, ["d", "tag"])
    kept = F.substring("text", F.lit(1), (length - F.floor(length / 3)).cast("int"))
    both = both.withColumn("edited", F.concat(kept, "head"))

    def judge(keys: Column) -> Column:
        def with_edited(edited: Column) -> Column:
            def with_hashes(own: Column) -> Column:
                return F.struct(
                    keys.alias("keys"), edited.alias("edited_keys"),
                    likeness(own, hashes(edited)).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next"),
                )

            return let(hashes(keys), with_hashes)

        return let(fingerprint(F.col("edited")), with_edited)

    both = both.select("d", length.alias("n_chars"), "edited", let(fingerprint(F.col("text")), judge).alias("f"))
    return both.select(F.nullif("d", F.lit(MIN_LONG)).alias("doc_id"), "n_chars", "edited", "f.*")
