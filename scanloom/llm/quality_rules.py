"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import with_statistics
from scanloom.session import settle


@dataclass(frozen=True)
class Rule:
    """Votes to reject from ``reject`` on, to keep up to ``keep``, and abstains in between.

    ``least`` is the number of units below which the rule has too little to go by and abstains.
    """

    name: str
    part: str
    whole: str
    keep: float
    reject: float
    least: int = 20

    def vote(self) -> Column:
        share = F.col(self.part) / F.greatest(F.col(self.whole), F.lit(1))
        said = F.when(share >= self.reject, -1).when(share <= self.keep, 1).otherwise(0)
        return F.when(F.col(self.whole) < self.least, 0).otherwise(said).cast("int")


#: Production rules over the statistics of ``common.statistics``.
RULES = (
    Rule("repeats", "n_repeat_words", "n_words", 0.05, 0.3),
    Rule("symbols", "n_symbols", "word_chars", 0.01, 0.05, 60),
    Rule("symbol_words", "n_symbols", "n_words", 0.05, 0.25),
    Rule("same_lines", "n_dup_lines", "n_lines", 0.0, 0.4, 4),
    Rule("capitals", "n_upper", "n_letters", 0.2, 0.5, 60),
    Rule("shouts", "n_shouts", "n_words", 0.05, 0.3),
    Rule("stutter", "n_runs", "n_words", 0.03, 0.2),
    Rule("bars", "n_bars", "n_words", 0.02, 0.2),
    Rule("loose_lines", "n_loose", "n_lines", 0.2, 0.9, 4),
    Rule("one_word", "n_top", "n_words", 0.12, 0.3),
    Rule("marks", "n_marks", "word_chars", 0.08, 0.2, 60),
)


@dataclass
class Accuracies:
    """Result of the estimation: prior of a good document and, per rule, P(reject | cast, bad or good)."""

    prior: float
    reject: np.ndarray
    rounds: int
    names: list[str] = field(default_factory=list)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of ``patterns`` (values -1, 0, 1).

        Rules are independent given the class; an abstention says nothing, so a row of abstentions gets the prior.
        """
        against, of = (patterns < 0).astype(float), (patterns > 0).astype(float)
        log = np.log([1 - self.prior, self.prior]) + against @ np.log(self.reject) + of @ np.log(1 - self.reject)
        p = np.exp(log - log.max(1, keepdims=True))
        return p[:, 1] / p.sum(1)

    def accuracy(self) -> dict[str, float]:
        """Share of right votes among the votes cast, per rule."""
        right = (1 - self.prior) * self.reject[:, 0] + self.prior * (1 - self.reject[:, 1])
        return dict(zip(self.names, map(float, right)))


def estimate(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 200, bad: float = 0.3,
             good: float = 0.01, trust: float = 50.0) -> Accuracies:
    """Fit the rules' accuracies to the counted vote patterns.

    A rule is at first believed to reject ``bad`` of the bad and ``good`` of the good documents on which it votes:
    each rule knows one kind of junk and is silent on or content with the others. The belief weighs as much as
    ``trust`` documents, whatever their number: it settles which of the two classes is the good one, and washes out as
    the documents grow.
    """
    rules = patterns.shape[1]
    total = float(counts.sum())
    belief = np.tile([bad, good], (rules, 1))
    weight = trust * np.array([0.2, 0.8])
    against, cast = (patterns < 0).astype(float), (patterns != 0).astype(float)
    state = Accuracies(0.8, belief, 0, names)
    for done in range(1, rounds + 1):
        p = state.posterior(patterns)
        mass = np.stack([(1 - p) * counts, p * counts], 1)
        reject = (against.T @ mass + belief * weight) / (cast.T @ mass + weight)
        prior = float((mass[:, 1].sum() + 4) / (total + 5))
        moved = max(abs(prior - state.prior), float(np.abs(reject - state.reject).max()))
        state = Accuracies(prior, reject, done, names)
        if moved < 1e-7:
            break
    return state


def with_votes(stats: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``votes``: one character per rule, ``-`` reject, ``0`` abstain, ``+`` keep."""
    sign = [F.when(r.vote() < 0, "-").when(r.vote() > 0, "+").otherwise("0") for r in rules]
    return stats.withColumns({"n_letters": F.col("n_upper") + F.col("n_lower"), "n_loose": F.col("n_lines") - F.col("n_ended")}) \
        .withColumn("votes", F.concat(*sign)).drop("n_letters", "n_loose")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5,
                  least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """Verdict of the weighed rules on every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns per input row doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, votes, posterior (of being good), kept. Repeated rows
    are judged one by one. NULL and empty texts have no words, so they fail the base law; an empty table gives an
    empty result.

    One pass over the texts; then only vote patterns (at most 3 ** rules of them, whatever the input) are counted,
    fitted on the driver and joined back.
    """
    stats = settle(with_votes(with_statistics(docs), rules))
    counted = stats.groupBy("votes").count().toPandas()
    value = {"-": -1, "0": 0, "+": 1}
    patterns = np.array([[value[c] for c in v] for v in counted["votes"]], np.int64).reshape(-1, len(rules))
    fitted = estimate(patterns, counted["count"].to_numpy(float), [r.name for r in rules])
    table = stats.sparkSession.createDataFrame(
        [(v, float(p)) for v, p in zip(counted["votes"], fitted.posterior(patterns))], "votes string, posterior double"
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return stats.join(F.broadcast(table), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "votes", "posterior", (~failed & (F.col("posterior") >= threshold)).alias("kept"),
    )
