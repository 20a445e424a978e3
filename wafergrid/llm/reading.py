"""Reading level of English prose.

Method: words are ranked by their frequency in the whole corpus; of each document the smallest rank is found such that
the words up to it cover a fixed share of the document's tokens. Plain texts are covered by few frequent words, texts
for specialists need rare ones. A rare word dropped into a plain text moves no share below it, so shares of a half to
four fifths judge the body as a whole. These coverage ranks and the words per sentence (on log scales) are calibrated
in SQL on labelled texts: by level the median and the spread between the quartiles, which raters' errors hardly move;
a text gets the level under which its measures are likeliest.

Whether a text is English is learned as well: how often each word occurs in texts that are labelled English and in texts
labelled otherwise gives it a weight (the log of the odds), and the weights of a text's words are added up. Wrong labels
are outnumbered, as each word is judged by all texts of the corpus. Prose is told by its form alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wafergrid.functions.paths import once
from wafergrid.session import written

WORD = r"(?<![\p{L}\p{N}_])[a-z]+(?:[-'’][a-z]+)*(?![\p{L}\p{N}_])"
PURE = r"(?<!\S)[(\[\"'“‘]*\p{L}+(?:[-'’]\p{L}+)*[.,;:!?)\]\"'”’]*(?!\S)"


@dataclass(frozen=True)
class LevelParams:
    """``vocabulary``: the ranks of so many words are broadcast, all others meet theirs by word. ``shares``: covered shares of the tokens. ``labelled``: at most so many labelled rows calibrate. ``least_spread`` and
    ``least_pace_spread``: spreads below it count as so much; the wide one lets sentence length decide only where coverage
    doesn't, as run-on sentences of plain words and terse ones of rare words both occur. ``pure`` and ``least_words``: prose has at least this share of plain words among
    what blanks separate, and so many words."""

    vocabulary: int = 20_000
    shares: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8)
    labelled: int = 100_000
    least_spread: float = 0.12
    least_pace_spread: float = 0.5
    pure: float = 0.7
    least_words: int = 5


def measured(texts: DataFrame, key: str, text: str, params: LevelParams, *keep: str) -> DataFrame:
    """(key, keep..., words ARRAY<STRING>, n_sentences, prose BOOLEAN): tags, control characters and zero-width characters count as nothing. NULL texts have no words. ``prose`` tells by the form, whatever the language."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<[^<>]{1,80}>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\p{Cf}]", ""), r"\p{Cc}", " ")
    df = once(texts.select(key, *keep, text), "__t", F.lower(bare)).drop(text)
    t = F.col("__t")
    df = df.select(
        key, *keep, F.regexp_extract_all(t, F.lit(WORD), 0).alias("words"), F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"[.!?](?=\s|$)"))).alias("n_sentences"),
        F.regexp_count(t, F.lit(r"\S+")).alias("__n"), F.regexp_count(t, F.lit(PURE)).alias("__pure"),
    )
    prose = (F.size("words") >= params.least_words) & (F.size("words") >= params.pure * F.col("__n")) & (F.col("__pure") >= params.pure * F.col("__n"))
    return df.select(key, *keep, "words", "n_sentences", prose.alias("prose"))


def ranked_words(texts: DataFrame, english: str) -> DataFrame:
    """(word, rank, weight): all words of all texts. Rank 1 is the most frequent, equal counts in alphabetical order; sorted in ranges, which are numbered one after the other.

    ``weight``: log of the odds that a text with the word has a true ``english``, by its tokens in texts where it is true
    and false, one added to each. Texts where it is NULL count for the ranks only.
    """
    counts = texts.select(F.explode("words").alias("word"), F.col(english).alias("e")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("e").alias("yes"), F.count_if(~F.col("e")).alias("no"))
    placed = written(counts.orderBy(F.desc("n"), "word").select("word", F.monotonically_increasing_id().alias("id"), "yes", "no"), "sorted_words")
    weight = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    part = F.shiftright("id", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    within = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("word", (F.col("before") + within + 1).cast("int").alias("rank"), weight.alias("weight"))


def coverage(texts: DataFrame, ranks: DataFrame, key: str | list[str], params: LevelParams) -> DataFrame:
    """(key..., english, x0, x1, ...): whether the weights of the words add up to 0 or more; log of the smallest rank that covers each share of the tokens, and of the words per sentence.

    ``texts``: key, words, n_sentences. A text without words has no row. The texts are dealt by key once; counting and
    covering follow without another shuffle, unless there are more words than are broadcast: then the counts of all
    others, none of them frequent, meet their ranks by word. Words without a rank come last, at a weight of 0.
    """
    keys = [key] if isinstance(key, str) else list(key)
    last = ranks.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    words = texts.repartition(*keys).select(*keys, F.size("words").alias("n_words"), "n_sentences", F.explode("words").alias("word"))
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("n_sentences").alias("n_sentences"))
    counts = counts.join(F.broadcast(ranks.where(F.col("rank") <= params.vocabulary)), "word", "left")
    if last > params.vocabulary:
        ranked = counts.where("rank is not null")
        rest = counts.where("rank is null").drop("rank", "weight").join(ranks.where(F.col("rank") > params.vocabulary), "word", "left")
        counts = ranked.unionByName(rest)
    counts = counts.drop("word").withColumn("rank", F.coalesce("rank", F.lit(max(params.vocabulary, last) + 1)))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("rank"))  # equal ranks count together
    covered = counts.withColumn("upto", upto)
    at = [F.log(F.min(F.when(F.col("upto") >= s * F.col("n_words"), F.col("rank"))).cast("double")).alias(f"x{i}") for i, s in enumerate(params.shares)]
    pace = F.log(F.first("n_words") / F.first("n_sentences")).alias(f"x{len(params.shares)}")
    return covered.groupBy(*keys).agg((F.sum(F.coalesce("weight", F.lit(0.0))) >= 0).alias("english"), *at, pace)


def calibrated(measures: DataFrame, level: str, params: LevelParams) -> list[dict]:
    """One dict a level: the level, and the centre and spread of each measure. ``measures``: level, x0, x1, ..."""
    n = len(params.shares) + 1
    aggs = []
    for i in range(n):
        least = params.least_spread if i < n - 1 else params.least_pace_spread
        q = F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.element_at(q, 2).alias(f"m{i}"), F.greatest((F.element_at(q, 3) - F.element_at(q, 1)) / 1.349, F.lit(least)).alias(f"s{i}")]
    return [r.asDict() for r in measures.groupBy(F.col(level).alias("level")).agg(*aggs).orderBy("level").collect()]  # one row a level


def with_level(measures: DataFrame, calibration: list[dict], params: LevelParams) -> DataFrame:
    """``measures`` with the likeliest ``level`` (the lowest of equally likely ones; NULL without calibration)."""
    if not calibration:
        return measures.withColumn("level", F.lit(None).cast("int"))
    n, scored = len(params.shares) + 1, []
    for c in calibration:
        unlikely = sum((F.pow((F.col(f"x{i}") - c[f"m{i}"]) / c[f"s{i}"], F.lit(2.0)) / 2 + math.log(c[f"s{i}"]) for i in range(n)), F.lit(0.0))
        scored.append(F.struct(unlikely.alias("unlikely"), F.lit(int(c["level"])).alias("level")))
    return measures.withColumn("level", F.array_min(F.array(*scored))["level"])
