"""Quality filtering by weak supervision, in DataFrame expressions only.

Rules over a document's statistics vote good (1), bad (-1) or abstain (0).
Expectation-maximisation on the counts of vote patterns, over all documents,
estimates how often each rule gives each vote on good and on bad documents; a
document's posterior probability of being good follows from its votes.  At most
``3 ** len(RULES)`` pattern counts reach the driver, whatever the input's size.

Words are the runs of characters other than ``\\x20 \\x09-\\x0D``.  Null texts
have no words; every statistic of a text without words is 0.  An empty table
gives no rows.  Repeated rows, null ids and extra columns are carried as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, keyed

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SYMBOL = r"[#*$%&|<>]"
#: Letters, joined by apostrophes or hyphens, with punctuation around them.
PLAIN_WORD = r"^[(\"'“«¿¡]*\p{L}+(?:['’-]\p{L}+)*[.,;:!?…)\"'”»]*$"
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def grams_of(words: Column, k: int) -> Column:
    """A 64-bit hash of each window of ``k`` words, in order; empty if there are fewer words."""
    gram = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])
    )
    return let(F.transform(words, lambda w: F.xxhash64(w)), gram)


def repeated(grams: Column) -> Column:
    """Words that lie in windows found twice or more, the first one included."""

    def covered(pairs: Column) -> Column:
        same = lambda e, i: (e["g"] == F.get(pairs, i - 1)["g"]) | (e["g"] == F.get(pairs, i + 1)["g"])
        places = F.sort_array(F.transform(F.filter(pairs, lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))
        # a window adds what lies beyond the end of the one before
        end = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(places, end, step, lambda a: a["n"])

    def count(g: Column) -> Column:
        tagged = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(tagged, covered)).otherwise(0)

    return let(grams, count)


def statistics(text: Column) -> Column:
    """One struct with all that the rules and the base filter look at."""

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        body = lambda x: [
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda s: s.rlike(r"[.!?\"'”»…]\s*$"))).cast("long").alias("n_ended_lines"),
        ]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            repeated(grams_of(words, WINDOW)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain_words"),
            F.size(F.filter(words, lambda w: w.rlike(SYMBOL))).cast("long").alias("n_symbol_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            let(lines, lambda x: F.struct(*body(x))).alias("lines"),
        )

    return let(words_of(text), of)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(s: Column) -> dict[str, Column]:
    """The votes; thresholds are per word or per line, so texts of any length are judged alike."""
    n, lines = s["n_words"], s["lines"]
    words, rows = F.greatest(n, F.lit(1)), F.greatest(lines["n_lines"], F.lit(1))
    return {
        "length": vote(n < 10, n >= 30),
        "word_length": vote((s["word_chars"] > 12 * words) | (s["word_chars"] < 2 * words), s["word_chars"].between(3 * words, 9 * words)),
        "symbols": vote(s["n_symbols"] * 10 > words, s["n_symbols"] * 50 < words),
        "plain_words": vote(s["n_plain_words"] * 10 < 7 * words, s["n_plain_words"] * 10 >= 9 * words),
        "symbol_words": vote(s["n_symbol_words"] * 5 > words, s["n_symbol_words"] * 20 < words),
        "repeats": vote(s["n_repeat_words"] * 100 > 20 * words, s["n_repeat_words"] * 100 <= 5 * words),
        "dup_lines": vote(lines["n_dup_lines"] * 2 > rows, lines["n_dup_lines"] == 0),
        "variety": vote((n >= 50) & (s["n_distinct"] * 10 < 3 * words), s["n_distinct"] * 10 >= 4 * words),
        "endings": vote(lines["n_ended_lines"] * 10 < 3 * rows, lines["n_ended_lines"] * 10 >= 6 * rows),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good, and of each rule's votes, by expectation-maximisation.

    Begins from rules that seldom vote bad on a good document, and often miss a
    bad one; a little of that stays in as a prior, so a rule that never votes bad
    keeps a defined weight.
    """
    total = sum(patterns.values())
    m = len(next(iter(patterns), ()))
    start = {1: {1: 0.85, 0: 0.13, -1: 0.02}, 0: {1: 0.55, 0: 0.15, -1: 0.3}}
    prior, tables = 0.8, [{y: dict(start[y]) for y in (0, 1)} for _ in range(m)]
    strength = 1 + 0.01 * total
    for _ in range(rounds if total else 0):
        mass = {0: 0.0, 1: 0.0}
        seen = [{y: {v: strength * start[y][v] for v in (-1, 0, 1)} for y in (0, 1)} for _ in range(m)]
        for pattern, count in sorted(patterns.items()):
            p = {y: math.log(prior if y else 1 - prior) + sum(math.log(t[y][v]) for t, v in zip(tables, pattern, strict=True)) for y in (0, 1)}
            good = count / (1 + math.exp(min(700.0, p[0] - p[1])))
            for y, w in ((1, good), (0, count - good)):
                mass[y] += w
                for t, v in zip(seen, pattern, strict=True):
                    t[y][v] += w
        prior = min(0.999, max(0.001, (mass[1] + 0.8 * strength) / (total + strength)))
        tables = [{y: {v: t[y][v] / sum(t[y].values()) for v in t[y]} for y in (0, 1)} for t in seen]
    return math.log(prior / (1 - prior)), [{v: math.log(t[1][v] / t[0][v]) for v in (-1, 0, 1)} for t in tables]


def judged(measured: DataFrame, stats: str = "stats") -> Callable[[DataFrame], DataFrame]:
    """Fits the rules' weights on ``measured``; the function adds ``posterior``,
    ``base_failed`` and ``kept`` to any frame with the same statistics."""
    votes = rules(F.col(stats))
    names = list(votes)
    counts = measured.groupBy(*[v.cast("int").alias(k) for k, v in votes.items()]).count().collect()  # <= 3 ** len(names)
    none = {(0,) * len(names): 0}
    odds, weights = estimate({tuple(r[k] for k in names): r["count"] for r in counts} or none)

    def judge(df: DataFrame) -> DataFrame:
        s = F.col(stats)
        total = F.lit(float(odds))
        for name, w in zip(names, weights, strict=True):
            v = votes[name]
            total = total + F.when(v == 1, F.lit(float(w[1]))).when(v == -1, F.lit(float(w[-1]))).otherwise(F.lit(float(w[0])))
        failed = (s["n_words"] < 10) | (F.lit(100) * s["n_repeat_words"] > F.lit(20) * s["n_words"])
        df = df.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-500.0)), F.lit(500.0)))))
        return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))

    return judge


def quality(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of ``docs`` with ``stats``, ``posterior``, ``base_failed`` and ``kept``.

    The statistics are computed once and kept in the checkpoint folder; texts are not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = checkpointed(docs.select(*keep, statistics(text).alias("stats")))
    return judged(measured)(measured)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    The statistics are computed once and kept by document; rows that share
    ``doc_id`` and text share their verdict, so a semi join picks them.
    """
    base = keyed(docs)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    measured = checkpointed(base.select("d", "tag", statistics(text).alias("stats")))
    return base.join(judged(measured)(measured).where("kept").select("d", "tag"), ["d", "tag"], "left_semi").select("row.*")
