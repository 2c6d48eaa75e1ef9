"""Quality rules: document statistics and a learned decision list, all in DataFrame functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, Scratch, carried

SYMBOLS = r"[^#*$%&|<>]+"
#: What rules may test: name and value over the statistics below; 0 where a text has no words.
FEATURES = {
    "n_words": "CAST(fl_n_words AS DOUBLE)",
    "mean_word_chars": "fl_word_chars / greatest(fl_n_words, 1)",
    "symbols_a_word": "fl_n_symbols / greatest(fl_n_words, 1)",
    "dup_line_share": "fl_n_dup_lines / greatest(fl_n_lines, 1)",
    "repeat_word_share": "fl_n_repeat_words / greatest(fl_n_words, 1)",
    "upper_share": "fl_n_upper / greatest(fl_word_chars, 1)",
    "mark_share": "fl_n_marks / greatest(fl_word_chars, 1)",
    "words_a_line": "fl_n_words / greatest(fl_n_lines, 1)",
}


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with fl_n_words, fl_word_chars, fl_n_symbols, fl_n_lines, fl_n_dup_lines, fl_n_repeat_words, fl_n_upper, fl_n_marks.

    Null text has no words and all counts 0. Whole texts: repeated three-word windows are found by sorting the hashes
    of a document's windows, so the cost is n log n in its words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace("fl_t", F.lit(pattern), F.lit(""))).cast("long")
    d = docs.withColumn("fl_t", text).withColumn("fl_trim", F.btrim("fl_t", F.lit(SPACES)))
    d = d.withColumn("fl_words", F.when(F.col("fl_trim") == "", F.array().cast("array<string>")).otherwise(F.split("fl_trim", SPACE)))
    d = d.withColumns({
        "fl_n_words": F.size("fl_words").cast("long"),
        "fl_word_chars": without(SPACE),
        "fl_n_symbols": without(SYMBOLS),
        "fl_n_upper": without(r"[^\p{Lu}]+"),
        "fl_n_marks": without(r"[^!?]+"),
        "fl_lines": F.filter(F.split("fl_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "fl_windows": F.when(F.size("fl_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("fl_words") - 3), lambda i: F.xxhash64(F.get("fl_words", i), F.get("fl_words", i + 1), F.get("fl_words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    })
    d = d.drop("fl_words", "fl_trim", "fl_t")
    d = d.withColumn("fl_n_lines", F.size("fl_lines").cast("long")).withColumn("fl_n_dup_lines", (F.size("fl_lines") - F.size(F.array_distinct("fl_lines"))).cast("long")).drop("fl_lines")
    again = F.size(F.array_distinct("fl_windows")) < F.size("fl_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("fl_sorted", F.when(again, F.sort_array(F.transform("fl_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("fl_windows")
    at = F.transform("fl_sorted", lambda x, k: F.when((F.get("fl_sorted", k - 1)["h"] == x["h"]) | (F.get("fl_sorted", k + 1)["h"] == x["h"]), x["i"]))
    d = d.withColumn("fl_at", F.sort_array(F.filter(at, lambda x: x.isNotNull()))).drop("fl_sorted")
    covered = F.aggregate("fl_at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"].cast("long"))
    return d.withColumn("fl_n_repeat_words", covered).drop("fl_at")


def base_failed() -> Column:
    return (F.col("fl_n_words") < 50) | (100 * F.col("fl_n_repeat_words") > 50 * F.col("fl_n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>=' if self.at_least else '<'} {self.threshold!r}D)"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; a document that none of them matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self) -> Column:
        """The 1-based number of the first rule that matches, 0 for none."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            test = F.expr(" AND ".join(c.sql() for c in rule))
            out = F.when(test, k) if out is None else out.when(test, k)
        return F.lit(0) if out is None else out.otherwise(0)


def with_condition(rule: tuple[Condition, ...], more: Condition) -> tuple[Condition, ...]:
    """The rule with one condition more; of two on one feature in one direction the narrower stays."""
    same = [c for c in rule if (c.feature, c.at_least) == (more.feature, more.at_least)]
    if not same:
        return (*rule, more)
    narrow = max if more.at_least else min
    one = Condition(more.feature, more.at_least, narrow(same[0].threshold, more.threshold))
    return tuple(one if c is same[0] else c for c in rule)


def best_condition(counts: dict[str, list[tuple[int, int, int]]], cut: dict[str, list[float]], banned: set[tuple[str, bool]]) -> Condition | None:
    """The condition with the greatest FOIL gain: counts has, for each feature, (bin, rows looked for, other rows), where bin k
    holds the values from cut k - 1 up to below cut k. None if no condition gains.
    """
    best, found = 1e-9, None
    for f, bins in counts.items():
        p0, n0 = sum(x[1] for x in bins), sum(x[2] for x in bins)
        if not p0 or not n0:
            continue
        base, at, p, n = math.log2(p0 / (p0 + n0)), {b: (q, m) for b, q, m in bins}, 0, 0
        for k, threshold in enumerate(cut[f]):
            q, m = at.get(k, (0, 0))
            p, n = p + q, n + m  # the rows below this cut
            for at_least, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = pp * (math.log2(pp / (pp + nn)) - base) if pp and (f, at_least) not in banned else 0.0
                if gain > best:
                    best, found = gain, Condition(f, at_least, float(threshold))
    return found


def pruned(counts: list[tuple[int, int]]) -> int:
    """How many first conditions to keep, given what the rule then matches of the pruning rows (looked for, others): the most
    by (p - n) / (p + n), the fewest of equals.
    """
    return max(range(len(counts)), key=lambda k: ((counts[k][0] - counts[k][1]) / max(1, sum(counts[k])), -k)) + 1


def learn(rows: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_support: float = 0.001, patience: int = 4) -> DecisionList:
    """Sequential covering over rows of statistics and `quality` (0 is what rules look for; null rows are ignored). Rows that the
    base test fails never reach the list, so it doesn't learn from them.

    Two thirds of the rows grow a rule, condition by condition, by FOIL gain over `bins` quantiles of each feature among the rows of
    either kind; the rest prune its last conditions by (p - n) / (p + n). A rule stays in the list if it is right on
    `min_precision` of the pruning rows it matches and of the growing rows, and finds `min_support` of all and three rows; what it
    matches is then covered. If it does not stay, the condition it began with may begin no other rule until one stays; `patience`
    such rules in a row end the list. Every step is one aggregation of at most features x bins rows. Without rows of both kinds: no rules.
    """
    names = list(FEATURES)
    d = rows.where("quality IS NOT NULL").where(~base_failed()).select("quality", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).alias("part"), *[F.expr(FEATURES[f]).alias(f) for f in names])
    share = [i / bins for i in range(bins)]
    cuts = d.groupBy(F.col("quality") == 0).agg(*[F.percentile_approx(f, share, 10_000).alias(f) for f in names]).collect()
    if len(cuts) < 2:
        return DecisionList(())
    cut = {f: sorted({x for r in cuts for x in r[f]}) for f in names}
    stacked = ", ".join(f"'{f}', size(filter(array({', '.join(f'{x!r}D' for x in v)}), x -> x <= {f}))" for f, v in cut.items())
    found: list[tuple[Condition, ...]] = []
    banned: set[tuple[str, bool]] = set()
    begun: dict | None = None  # the counts that a rule begins with, the same until one stays

    def holds(rule: tuple[Condition, ...]) -> str:
        return " AND ".join(f"({c.feature} {'>=' if c.at_least else '<'} {c.threshold!r}D)" for c in rule) or "true"

    while len(found) < max_rules and len(banned) < patience:
        left = d.where(" AND ".join(f"NOT ({holds(r)})" for r in found) or "true")
        grown: list[tuple[Condition, ...]] = []
        while len(grown) < max_conditions:
            rule = grown[-1] if grown else ()
            if rule or begun is None:
                grid = left.where("part < 2").where(holds(rule)).selectExpr("quality", f"stack({len(cut)}, {stacked}) AS (f, b)")
                got = grid.groupBy("f", "b").agg(F.sum((F.col("quality") == 0).cast("long")).alias("p"), F.sum((F.col("quality") != 0).cast("long")).alias("n")).collect()
                counts = {f: sorted((r["b"], r["p"], r["n"]) for r in got if r["f"] == f) for f in cut}
                begun = begun if rule else counts
            best = best_condition(counts if rule else begun, cut, set() if grown else banned)
            if best is None:
                break
            grown.append(with_condition(rule, best))
        if not grown:
            break
        count = lambda rule, part, kind: F.sum(F.expr(f"CAST({holds(rule)} AND part {part} AND quality {kind} AS BIGINT)"))
        v = [x or 0 for x in left.agg(*[count(r, part, kind) for r in grown for part in ("< 2", "= 2") for kind in ("= 0", "<> 0")], F.count("*")).first()]
        k = pruned([(v[4 * i + 2], v[4 * i + 3]) for i in range(len(grown))]) - 1
        p, n, pp, pn = v[4 * k : 4 * k + 4]
        if p < min_precision * (p + n) or pp < min_precision * (pp + pn) or p + pp < max(3, min_support * v[-1]):
            banned.add((grown[0][0].feature, grown[0][0].at_least))
            continue
        found.append(grown[k])
        banned.clear()
        begun = None
    return DecisionList(tuple(found))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one label for each id; of contrary ones the lower."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Statistics of the documents with a quality label, once per doc_id, written to the shared folder."""
    # texts are counted where they are read; only the counts are shuffled
    stats = with_statistics(docs.select("doc_id", "text")).drop("text")
    return scratch.keep(stats.join(known_labels(labels), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, **how) -> DecisionList:
    return learn(labelled_statistics(docs, labels, scratch), **how)


def with_verdict(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows of statistics with fl_base_failed, fl_rule (the rejecting rule or 0) and fl_kept."""
    d = stats.withColumn("fl_base_failed", base_failed()).withColumn("fl_rule", rules.rejects())
    # always true, but not deterministic: a filter on fl_kept then stays above the statistics instead of repeating them
    once = F.monotonically_increasing_id() >= 0
    return d.withColumn("fl_kept", once & ~F.col("fl_base_failed") & (F.col("fl_rule") == 0))


def filtered(docs: DataFrame, labels: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of docs that pass the base test and that no rule learned from labels rejects; columns as in docs.

    Null and empty texts have no words and fail the base test; repeated rows are treated alike; a text counts whole. Without
    labels of both kinds there are no rules and the base test alone decides. No rows: no rows.
    """
    rules = fit(docs, labels, scratch, **how)
    return with_verdict(with_statistics(carried(docs, "text")), rules).where("fl_kept").select("fl_all.*")
