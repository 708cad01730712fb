"""The best targets of each value by a score, without comparing every value with every target.

Rounds lower a bound. A round's pairs hold every pair whose score reaches its bound, so a value that has ``top`` targets at the
bound or above is settled: no target that it hasn't met can enter its best. Only the others go into the next round. Pairs
come from inverted indexes of tokens: of two texts that must share many tokens, the rarest tokens of each, as many as could
be missing and one more, already share one, so only those are joined, and frequent tokens hardly ever are. All joins are
on tokens, lengths or texts; none is on a constant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import similarity
from lodestar.session import cut

#: Letters of a gram.
GRAM = 2


@dataclass(frozen=True)
class Round:
    """``pairs`` of the frames (__v) and (__t) holds each pair whose score is ``bound`` or more."""

    bound: float
    pairs: Callable[[DataFrame, DataFrame], DataFrame]


def numbered_tokens(tokens: Column) -> Column:
    """Each token with how many equal ones stand before it: tokens shared as sets are then tokens shared as often as both have them."""
    return F.transform(tokens, lambda g, i: F.concat_ws("\x01", F.size(F.filter(F.slice(tokens, 1, i), lambda x: x == g)).cast("string"), g))


def grams(text: Column, n: int = GRAM) -> Column:
    """Runs of ``n`` letters, with marks before and behind the text: length + n - 1 of them."""
    padded = F.concat(F.lit("\x02" * (n - 1)), text, F.lit("\x03" * (n - 1)))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + n - 1), lambda k: F.substring(padded, k, F.lit(n)))


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def rarest_meet(values: DataFrame, targets: DataFrame, tokens: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """Pairs (__v, __t) that share one of their ``keep`` (of the number of tokens) rarest tokens, and the numbers of both."""
    sides = []
    for side, df in (("__v", values), ("__t", targets)):
        own = df.select(side, tokens(F.col(side)).alias("__k")).withColumn("__n", F.size("__k"))
        sides.append(own.select(side, "__n", F.explode("__k").alias("__k")))
    often = sides[0].select("__k").unionAll(sides[1].select("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("__often"))
    few = []
    for side, df in zip(("__v", "__t"), sides, strict=True):
        order = W.partitionBy(side).orderBy("__often", "__k")
        ranked = df.join(often, "__k").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= keep(F.col("__n")))
        few.append(ranked.select(side, F.col("__n").alias(f"{side}_n"), "__k"))
    return few[0].join(few[1], "__k").select("__v", "__t", "__v_n", "__t_n").distinct()


def within_distance(d: int, longest: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Pairs of an edit distance of ``d`` at most, and others. An edit breaks at most GRAM grams, so texts of more than
    d * GRAM grams share one; of two shorter texts only the lengths say something."""

    def pairs(values: DataFrame, targets: DataFrame) -> DataFrame:
        most = d * GRAM
        near = rarest_meet(values, targets, lambda c: numbered_tokens(grams(c)), lambda n: F.lit(most + 1)).where(F.abs(F.col("__v_n") - F.col("__t_n")) <= d).select("__v", "__t")
        n = F.char_length("__v")
        short = min(most - GRAM + 1, longest)
        if short < 0:
            return near
        reach = F.sequence(F.greatest(n - d, F.lit(0)), F.least(n + d, F.lit(short)))
        mine = values.where(F.char_length("__v") <= short).select("__v", F.explode(reach).alias("__n"))
        theirs = targets.where(F.char_length("__t") <= short).select("__t", F.char_length("__t").alias("__n"))
        return near.unionByName(mine.join(theirs, "__n").select("__v", "__t"))

    return pairs


def distance_rounds(values: DataFrame, targets: DataFrame, value: str, target: str) -> list[Round]:
    """Rounds for the score -levenshtein: distances 1, 3, 7 .., the last the longest text, which settles everything."""
    longest = max([0, *(df.agg(F.max(F.char_length(c)).alias("n")).first()["n"] or 0 for df, c in ((values, value), (targets, target)))])
    steps, d = [], 1
    while d < longest:
        steps.append(d)
        d = 2 * d + 1
    return [Round(-float(d), within_distance(d, longest)) for d in [*steps, max(longest, 1)]]


def likely(least: float) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Pairs whose similarity is ``least`` or more, and others: letters in matching blocks are shared letters, so a matched
    share of s needs s / (2 - s) of either text's letters; rules need words of one beginning, or initials."""

    def pairs(values: DataFrame, targets: DataFrame) -> DataFrame:
        keep = lambda n: n - F.ceil(n * (least / (2 - least)) - 1e-9) + 1
        near = rarest_meet(values, targets, lambda c: numbered_tokens(letters(similarity.plain(c))), keep)
        both = F.col("__v_n") + F.col("__t_n")
        near = near.where(2 * F.least("__v_n", "__t_n") >= least * both - 1e-9).select("__v", "__t")
        mine, theirs = (df.select(side, F.explode(similarity.openings(F.col(side))).alias("__k")).distinct() for side, df in (("__v", values), ("__t", targets)))
        return near.unionByName(mine.join(theirs, "__k").select("__v", "__t")).distinct()

    return pairs


#: Similarities of the rounds; at the last one a value meets every target that it shares a letter with.
SHARE_ROUNDS = tuple(Round(s, likely(s)) for s in (0.85, 0.6, 0.35, 0.0))


def nearest(values: DataFrame, targets: DataFrame, value: str, target: str, top: int, score: Column, rounds: list[Round] | tuple[Round, ...], standard: str | None = None) -> DataFrame:
    """value, target (the standard value), score, via, rank: the ``top`` standard values of each distinct value.

    ``score`` is over columns ``value`` and ``target``. A standard value may have several texts: the best one of each counts
    and stays beside it as ``via``. Ties go by the standard value, then the text. Null values and texts are left out. A
    target that no round brings to a value, as they share nothing, is none of its candidates.
    """
    left = cut(values.select(F.col(value).alias("__v")).where("__v IS NOT NULL").distinct())
    known = cut(targets.select(F.col(target).alias("__t"), F.col(standard or target).alias("__standard")).where("__t IS NOT NULL").distinct())
    texts = known.select("__t").distinct()
    done = []
    for k, r in enumerate(rounds):
        met = r.pairs(left, texts).distinct().select(F.col("__v").alias(value), F.col("__t").alias(target))
        scored = met.withColumn("score", score).select(F.col(value).alias("__v"), F.col(target).alias("__t"), "score").join(known, "__t")
        first = W.partitionBy("__v", "__standard").orderBy(F.desc("score"), "__t")
        via = scored.withColumn("__k", F.row_number().over(first)).where("__k = 1")
        order = W.partitionBy("__v").orderBy(F.desc("score"), "__standard")
        best = cut(via.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("__v", "__standard", "score", F.col("__t").alias("via"), "rank"))
        if k + 1 == len(rounds):
            done.append(best)
            break
        settled = best.where(F.col("score") >= r.bound).groupBy("__v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).select("__v")
        done.append(best.join(settled, "__v", "left_semi"))
        left = cut(left.join(settled, "__v", "left_anti"))
        if left.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("__v").alias(value), F.col("__standard").alias(target), "score", "via", "rank")
