"""Quality rules that vote, weighed by expectation-maximisation; DataFrame operations only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. There are at
most 3 ** (number of rules) vote patterns, so their counts over all documents
are bounded and go to the driver, where expectation-maximisation estimates how often
each rule is right on either class, and the share of good documents. A document's posterior
probability of being good replaces the filter that demands every rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import SPACES, let, materialise, table, words_of

SYMBOLS = "#*$%&|<>"


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that a text holds at least twice.

    One sort of (hash, position) brings equal windows together; hashes keep all
    their 64 bits, however long the text.
    """

    def counted(hashes: Column) -> Column:
        windows = F.slice(F.transform(hashes, lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.cast("long").alias("i"))), 1, F.size(hashes) - 2)

        def positions(s: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"]))

        spread = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(let(F.sort_array(windows), positions), spread)

    return F.when(F.size(words) >= 4, let(F.transform(words, lambda w: F.xxhash64(w)), counted)).otherwise(F.lit(0).cast("long"))


def text_facts(text: Column) -> Column:
    """What the rules look at, as a struct of longs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    length = lambda c: F.length(c).cast("long")

    def facts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
        dense = F.translate(t, SPACES, "")
        return F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))).alias("w"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
            let(dense, lambda d: F.struct(length(d).alias("word_chars"), (length(d) - length(F.translate(d, SYMBOLS, ""))).alias("n_symbols"), F.regexp_count(t, F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"), (length(d) - length(F.translate(d, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ", ""))).alias("n_upper"), (length(d) - length(F.translate(d, "!?.,;:", ""))).alias("n_punctuation"))).alias("c"),
        )

    return let(text, facts)


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions on the facts; where neither holds, or both do, the rule abstains."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]


_c = F.col
RULES = (
    Rule("length", lambda: _c("n_words") < 8, lambda: _c("n_words") >= 100),
    Rule("word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 12 * _c("n_words")), lambda: _c("word_chars").between(3 * _c("n_words"), 8 * _c("n_words"))),
    Rule("symbols", lambda: 100 * _c("n_symbols") > 3 * _c("word_chars"), lambda: 1000 * _c("n_symbols") <= 5 * _c("word_chars")),
    Rule("symbol_words", lambda: 100 * _c("n_symbol_runs") > 5 * _c("n_words"), lambda: 100 * _c("n_symbol_runs") <= _c("n_words")),
    Rule("duplicate_lines", lambda: 10 * _c("n_dup_lines") > 3 * _c("n_lines"), lambda: (_c("n_dup_lines") == 0) & (_c("n_lines") > 1)),
    Rule("repetition", lambda: 5 * _c("n_repeat_words") > _c("n_words"), lambda: 20 * _c("n_repeat_words") <= _c("n_words")),
    Rule("upper_case", lambda: 10 * _c("n_upper") > 3 * _c("word_chars"), lambda: 10 * _c("n_upper") <= _c("word_chars")),
    Rule("punctuation", lambda: 100 * _c("n_punctuation") > 18 * _c("word_chars"), lambda: (_c("n_punctuation") > 0) & (100 * _c("n_punctuation") <= 8 * _c("word_chars"))),
    Rule("variety", lambda: (_c("n_words") >= 20) & (20 * _c("n_distinct") < 3 * _c("n_words")), lambda: (_c("n_words") >= 20) & (10 * _c("n_distinct") >= 3 * _c("n_words"))),
)


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of good; for each rule, the chances of a vote -1, 0, 1 on a good and on a bad document."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def weight(self, rule: int, vote: int) -> float:
        return math.log(self.good[rule][vote + 1] / self.bad[rule][vote + 1])

    def accuracy(self, rule: int) -> float:
        """Of a vote that isn't an abstention."""
        right = self.prior * self.good[rule][2] + (1 - self.prior) * self.bad[rule][0]
        wrong = self.prior * self.good[rule][0] + (1 - self.prior) * self.bad[rule][2]
        return right / (right + wrong)

    def p_good(self, votes: tuple[int, ...]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(self.weight(k, v) for k, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(patterns: list[tuple[tuple[int, ...], int]], n: int, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation on counts of vote patterns of ``n`` rules.

    It starts from the documents that some rule calls bad. A rule may vote
    differently often on either class, but never in the wrong sense: a bad vote
    is at least as likely on a bad document, a good vote on a good one; where an
    estimate would turn that round, both classes get the common rate.
    """
    chance = {votes: 0.1 if min(votes, default=0) < 0 else 0.98 for votes, _ in patterns}
    model = LabelModel(0.5, ((1 / 3,) * 3,) * n, ((1 / 3,) * 3,) * n)
    for _ in range(rounds if patterns else 0):
        counts = [[[smooth] * 3 for _ in range(n)] for _ in range(2)]
        size = [smooth, smooth]
        for votes, count in patterns:
            for c, p in ((0, 1 - chance[votes]), (1, chance[votes])):
                size[c] += count * p
                for k, v in enumerate(votes):
                    counts[c][k][v + 1] += count * p
        rates = [[[x / sum(row) for x in row] for row in side] for side in counts]
        for k in range(n):
            for v, worse, better in ((0, 1, 0), (2, 0, 1)):
                if rates[worse][k][v] > rates[better][k][v]:
                    pooled = (counts[0][k][v] + counts[1][k][v]) / (sum(counts[0][k]) + sum(counts[1][k]))
                    rates[0][k][v] = rates[1][k][v] = pooled
            for c in (0, 1):
                total = sum(rates[c][k])
                rates[c][k] = [x / total for x in rates[c][k]]
        model = LabelModel(size[1] / sum(size), tuple(map(tuple, rates[1])), tuple(map(tuple, rates[0])))
        new = {votes: model.p_good(votes) for votes, _ in patterns}
        if max(abs(new[v] - chance[v]) for v in new) < 1e-9:
            break
        chance = new
    return model


def score_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``id_col``, the facts, each rule's vote (``vote_<name>``), ``p_good`` and ``verdict``.

    A null or empty text has no words and facts of 0. One row for each row of
    ``df``, repeated rows included; an empty table gives an empty result. Texts
    of any length are taken whole. A document whose posterior is the threshold
    is good. An ``id_col`` with the name of another column of the result comes
    out as ``id``; other columns of ``df`` don't matter.
    """
    names = [f"vote_{r.name}" for r in rules]
    facts = df.select(F.col(id_col).alias("_lf_id"), text_facts(F.col(text_col)).alias("_lf_f")).select("_lf_id", "_lf_f.w.*", "_lf_f.l.*", "_lf_f.c.*")
    taken = {*facts.columns, *names, "p_good", "verdict"}
    facts = facts.withColumnRenamed("_lf_id", "id" if id_col in taken else id_col)
    voted = materialise(facts.select("*", *[(r.good().cast("int") - r.bad().cast("int")).alias(n) for r, n in zip(rules, names, strict=True)]), "rule-votes")
    model = fit(sorted((tuple(x[n] for n in names), x["count"]) for x in voted.groupBy(*names).count().collect()), len(names))
    z = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, n in enumerate(names):
        z = z + F.when(F.col(n) < 0, model.weight(k, -1)).when(F.col(n) > 0, model.weight(k, 1)).otherwise(model.weight(k, 0))
    return voted.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumn("verdict", F.col("p_good") >= threshold)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), F.round("p_good", 6).alias("p_good"))
