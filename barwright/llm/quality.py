"""Quality rules: learned decision lists over text statistics, as DataFrame expressions.

Statistics are SQL expressions on the whole text. Rules are learned by sequential covering:
on two thirds of a bounded labelled sample a conjunction of thresholds grows by FOIL gain
until it covers bad texts only, on the other third it is pruned, and it is accepted only if it
is precise there; what it covers is set aside and the next one grows. The list becomes one
ordered conditional expression.

Defined results: null, blank and empty texts have 0 in all statistics; rows may repeat; an
empty table, or one without labels, gives no rules, and no text is rejected by a rule; other
columns stay, but one named like an output column, in any case, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.arrow import quoted
from barwright.llm.words import SPACES, word_array

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_rate", "bar_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "comma_rate", "stop_rate", "words_per_line", "log_words")


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns BASE (long) and FEATURES (double)."""
    made = {*BASE, *FEATURES}
    kept = [c for c in docs.columns if c.lower() not in made and (keep_text or c != text)]
    # other columns travel as one, beside which names can't clash
    base = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(quoted(c)).alias(f"c{n}") for n, c in enumerate(kept)]).alias("q_row"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("q_text"))
    body = F.col("q_text")
    # arrays used more than once are columns of a step of their own, so each is made once
    rows = base.withColumns({"q_words": word_array(body), "q_lines": F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    windows = F.when(F.size("q_words") < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.transform(F.slice("q_words", F.lit(1), F.greatest(F.size("q_words") - 2, F.lit(1))), lambda w, i: F.struct(F.xxhash64(w, F.get(F.col("q_words"), i + 1), F.get(F.col("q_words"), i + 2)).alias("h"), i.alias("p"))))
    rows = rows.withColumn("q_sorted", F.sort_array(windows))
    # neighbours in hash order that are equal: both windows repeat
    none = F.array().cast("array<int>")
    twice = F.flatten(F.zip_with("q_sorted", F.slice("q_sorted", F.lit(2), F.greatest(F.size("q_sorted"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none)))
    covered = F.aggregate(F.sort_array(twice), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")), lambda a, p: F.struct((p + 3).alias("end"), (a["sum"] + F.least(F.lit(3), p + 3 - a["end"])).alias("sum")), lambda a: a["sum"])
    size = lambda drop: F.length(F.translate("q_text", drop, ""))
    whole = F.length("q_text")
    rows = rows.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": size(SPACES).cast("long"),
        "n_symbols": (whole - size(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": covered,
        "q_upper": whole - F.length(F.translate("q_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÊÓÑ", "")),
        "q_digits": whole - size("0123456789"),
        "q_bars": whole - size("|"),
        "q_commas": whole - size(",.;:!?"),
        "q_short": F.size(F.filter("q_words", lambda w: F.length(w) <= 3)),
        "q_n_lines": F.size("q_lines"),
    })
    rate = lambda part, of: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    rows = rows.withColumns({
        "word_length": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "bar_rate": rate("q_bars", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "q_n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("q_upper", "word_chars"),
        "digit_rate": rate("q_digits", "word_chars"),
        "comma_rate": rate("q_commas", "n_words"),
        "stop_rate": rate("q_short", "n_words"),
        "words_per_line": rate("n_words", "q_n_lines"),
        "log_words": F.log1p(F.col("n_words").cast("double")),
    })
    # always true, but not to the optimizer: it must not move a caller's filter below, where each use would make the arrays again
    here = F.spark_partition_id() >= 0
    return rows.select(*[F.col("q_row").getField(f"c{n}").alias(c) for n, c in enumerate(kept)], *(F.when(here, F.col(c)).alias(c) for c in (*BASE, *FEATURES)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


class DecisionList:
    """Rules that reject; a text that none covers is kept."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    def rule_number(self) -> Column:
        """The first rule that holds, from 1; 0 if none does."""
        chain: Column | None = None
        for n, rule in enumerate(self.rules, 1):
            holds = rule[0].column()
            for condition in rule[1:]:
                holds = holds & condition.column()
            chain = F.when(holds, n) if chain is None else chain.when(holds, n)
        return F.lit(0) if chain is None else chain.otherwise(0)

    def covers(self, x: np.ndarray) -> np.ndarray:
        """The first rule that holds on each row of FEATURES, as ``rule_number`` has it."""
        out = np.zeros(len(x), dtype=np.int64)
        for n, rule in enumerate(self.rules, 1):
            out[(out == 0) & _covers(x, rule)] = n
        return out

    def __str__(self) -> str:
        return "\n".join(f"{n}. reject if {' and '.join(map(str, r))}" for n, r in enumerate(self.rules, 1)) or "keep all"


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for c in rule:
        column = x[:, FEATURES.index(c.feature)]
        hit &= column > c.threshold if c.above else column <= c.threshold
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the condition of the largest FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and (~bad[inside]).any():
        own, own_bad = x[inside], bad[inside]
        p0, n0 = own_bad.sum(), (~own_bad).sum()
        best: tuple[float, Condition] | None = None
        for k, name in enumerate(FEATURES):
            order = np.argsort(own[:, k], kind="stable")
            values = own[order, k]
            cut = np.flatnonzero(values[1:] > values[:-1])
            below_p, below_n = np.cumsum(own_bad[order])[cut], np.cumsum(~own_bad[order])[cut]
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
                if len(gain) and (best is None or gain.max() > best[0]):
                    at = cut[int(gain.argmax())]
                    best = (float(gain.max()), Condition(name, above, float((values[at] + values[at + 1]) / 2)))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        inside &= _covers(x, (best[1],))
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it wasn't grown on."""
    def worth(r: Rule) -> float:
        hit = _covers(x, r)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=rule)


def learn_rules(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Sequential covering on two thirds; a rule counts if on the other third it covers a bad row or more, with ``precision``, and ``least`` bad rows of all."""
    third = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < most_rules and bad[left & ~third].sum() >= least:
        grown = _grow(x[left & ~third], bad[left & ~third], most_conditions)
        if not grown:
            break
        rule = _prune(grown, x[left & third], bad[left & third]) if bad[left & third].any() else grown
        hit = _covers(x, rule) & left
        held = hit & third  # rows that neither grew nor chose it by themselves
        if (hit & bad).sum() < least or not (held & bad).any() or (held & bad).sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 4000) -> DecisionList:
    """Rules learned from at most ``sample_rows`` labelled rows, those whose id hashes lowest."""
    chosen = labels.select(F.col(quoted(id)).alias("q_id"), F.col(quoted(quality)).alias("q_quality")).where("q_id IS NOT NULL AND q_quality IS NOT NULL").groupBy("q_id").agg(F.min("q_quality").alias("q_label"))
    chosen = chosen.orderBy(F.xxhash64("q_id"), "q_id").limit(sample_rows)
    rows = with_statistics(docs.select(F.col(quoted(id)).alias("q_id"), F.col(quoted(text)).alias("q_body")).join(F.broadcast(chosen), "q_id"), "q_body", keep_text=False)
    found = rows.orderBy(F.xxhash64("q_id"), "q_id", *FEATURES).limit(2 * sample_rows).select(*FEATURES, "q_label", *BASE).collect()
    # the base rules reject these already
    found = [r for r in found if r["n_words"] >= 50 and 2 * r["n_repeat_words"] <= r["n_words"]]
    x = np.array([[r[f] for f in FEATURES] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return learn_rules(x, np.array([r["q_label"] == 0 for r in found], dtype=bool))
