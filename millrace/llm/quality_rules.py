"""Quality rules: learned decision lists over text statistics, in DataFrame and SQL functions only.

Statistics of a text come from array functions over its own row, so they need no shuffle. Sequential covering then
learns an ordered list of rules "share >= t and share < u ... -> reject" from labelled statistics: a rule grows by the
condition of best information gain on two thirds of the labelled rows, is pruned on the other third, and stays if it
is right there more often than not; rows it covers leave both parts before the next one grows. The list becomes one
CASE expression. Each growing step is one small aggregate over binned statistics; the driver sees only its
(feature, bin) counts, which don't grow with the data.

Defined cases: null text has no words; a document without words, or with fewer than `min_words`, fails the base rules;
null labels are ignored; without labels of both kinds the list is empty and the base rules alone decide. Repeated rows
are treated one by one. Added columns carry a prefix, so columns of the input keep their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, crc_mod

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares in thousandths that conditions may test.
FEATURES = {
    "symbol_share": ("n_symbols", "n_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "mean_word": ("word_chars", "n_words"),
}


def without(c: Column, chars: str) -> Column:
    return F.char_length(F.translate(c, chars, ""))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more. A window's hash and its place share one long
    (the place is the remainder by the number of windows), so one primitive sort puts equal windows side by side."""
    m = F.size(hashes).cast("long")
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftright(h, 1) - F.pmod(F.shiftright(h, 1), m) + i))

    def paired(s: Column) -> Column:
        place = lambda x: F.pmod(x, m)
        same = lambda x, y: (x - place(x) == y - place(y)) & (F.get(hashes, place(x).cast("int")) == F.get(hashes, place(y).cast("int")))
        return F.filter(F.transform(s, lambda x, k: F.when(((k > 0) & same(x, F.get(s, k - 1))) | ((k < m - 1) & same(x, F.get(s, k + 1))), place(x))), lambda x: x.isNotNull())

    starts = F.sort_array(F.get(F.transform(F.array(packed), paired), F.lit(0)))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    covered = F.aggregate(starts, zero, lambda a, x: F.struct((a.n + F.least(F.lit(3).cast("long"), x - a.last)).alias("n"), x.alias("last")), lambda a: a.n)
    return F.when(F.size(F.array_distinct(hashes)) == m, F.lit(0).cast("long")).otherwise(covered)


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the counts of each whole text (long) under the prefix."""
    c = lambda x: F.col(prefix + x)
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn(prefix + "body", F.btrim(raw, F.lit(SPACES)))
    out = out.withColumn(prefix + "words", F.when(c("body") == "", F.array().cast("array<string>")).otherwise(F.split(c("body"), SPACE_CLASS + "+")))
    out = out.withColumn(prefix + "lines", F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    out = out.withColumn(
        prefix + "hashes",
        F.when(F.size(c("words")) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2)))
        ),
    )
    out = out.withColumns(
        {
            prefix + k: v.cast("long")
            for k, v in {
                "n_chars": F.char_length(raw),
                "n_words": F.size(c("words")),
                "word_chars": without(raw, SPACES),
                "n_symbols": F.char_length(raw) - without(raw, SYMBOLS),
                "n_lines": F.size(c("lines")),
                "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
                "n_repeat_words": repeated_words(c("words"), c("hashes")),
                "n_distinct": F.size(F.array_distinct(c("words"))),
                "n_upper": F.char_length(raw) - without(raw, UPPER),
                "n_marks": F.char_length(raw) - without(raw, "!?"),
            }.items()
        }
    )
    return out.drop(prefix + "body", prefix + "words", prefix + "lines", prefix + "hashes")


def base_failed(prefix: str = "", min_words: int = 50) -> Column:
    return (F.col(prefix + "n_words") < min_words) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def shares(prefix: str = "") -> dict[str, Column]:
    """Whole thousandths; 0 where there is nothing to share."""
    c = lambda x: F.col(prefix + x)
    return {k: F.when(c(b) > 0, F.expr(f"1000 * `{prefix}{a}` div `{prefix}{b}`")).otherwise(F.lit(0)).cast("long") for k, (a, b) in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.threshold if self.at_least else columns[self.feature] < self.threshold


@dataclass
class DecisionList:
    """Ordered rules; a document is rejected by the first that covers it, and kept if none does."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self, prefix: str = "") -> Column:
        """Number of the first rule that covers the row, from 1; null if none."""
        columns, out = shares(prefix), None
        for k, rule in enumerate(self.rules, 1):
            covers = all_of([x.column(columns) for x in rule])
            out = F.when(covers, F.lit(k)) if out is None else out.when(covers, F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def kept(self, prefix: str = "", min_words: int = 50) -> Column:
        return ~base_failed(prefix, min_words) & self.fired(prefix).isNull()


def all_of(columns: list[Column]) -> Column:
    out = F.lit(True)
    for x in columns:
        out = out & x
    return out


def _thresholds(known: DataFrame, levels: int) -> dict[str, list[int]]:
    """Cut points of each feature: approximate quantiles within either class, over all labelled rows."""
    at = [k / levels for k in range(1, levels)]
    rows = known.groupBy("bad").agg(*[F.percentile_approx(f, at, 1000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({int(v) + d for r in rows for v in r[f] or [] for d in (0, 1)}) for f in FEATURES}


def _counts(binned: DataFrame) -> dict[tuple[str, bool], dict[int, tuple[int, int]]]:
    """(feature, grow part?) -> bin -> (bad rows, good rows): one aggregate over the rows that are left."""
    one = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))).alias("feature", "bin")
    rows = binned.select("grow", "bad_n", "good_n", one).groupBy("feature", "grow", "bin").agg(F.sum("bad_n").alias("p"), F.sum("good_n").alias("n")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r.feature, r.grow), {})[r.bin] = (r.p, r.n)
    return out


def _totals(counts: dict, grow: bool) -> tuple[int, int]:
    bins = counts.get((next(iter(FEATURES)), grow), {}).values()
    return sum(p for p, _ in bins), sum(n for _, n in bins)


def _grown(counts: dict, cuts: dict[str, list[int]]) -> tuple[float, Condition | None, tuple[int, int]]:
    """The condition of most information gain on the growing part, and what it covers there."""
    p0, n0 = _totals(counts, True)
    best, found, covers = 0.0, None, (p0, n0)
    if not p0:
        return best, found, covers
    for f in FEATURES:
        bins = counts.get((f, True), {})
        for k, t in enumerate(cuts[f]):
            above = [sum(v[j] for b, v in bins.items() if b > k) for j in (0, 1)]
            for at_least, (p, n) in ((True, above), (False, (p0 - above[0], n0 - above[1]))):
                if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best + 1e-9:
                    best, found, covers = gain, Condition(f, at_least, t), (p, n)
    return best, found, covers


def learn(stats: DataFrame, labels: DataFrame, prefix: str = "", max_rules: int = 8, max_conditions: int = 3, levels: int = 12, min_gain: float = 5.0) -> DecisionList:
    """stats: doc_id and the counts of with_statistics(); labels: doc_id, quality (label 0 is what rules reject)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    table = stats.select("doc_id", *[v.alias(k) for k, v in shares(prefix).items()], base_failed(prefix).alias("failed"))
    known = table.join(known, "doc_id").where("not failed").withColumn("bad", F.col("quality") == 0).withColumn("grow", crc_mod("doc_id", 3) != 2).drop("doc_id", "quality", "failed").cache()
    cuts = _thresholds(known, levels)
    number = {f: sum(((F.col(f) >= t).cast("int") for t in cuts[f]), F.lit(0)) for f in FEATURES}
    binned = known.select("grow", "bad", *[v.alias(f) for f, v in number.items()]).groupBy("grow", *FEATURES).agg(F.count_if("bad").alias("bad_n"), F.count_if(~F.col("bad")).alias("good_n")).cache()
    left, at = binned, {f: {t: k for k, t in enumerate(cuts[f])} for f in FEATURES}

    def covered(rule: list[Condition]) -> Column:
        return all_of([F.col(x.feature) > at[x.feature][x.threshold] if x.at_least else F.col(x.feature) <= at[x.feature][x.threshold] for x in rule])

    out = DecisionList()
    counts = _counts(left) if sum(map(len, cuts.values())) else {}
    while len(out.rules) < max_rules and counts:
        rule: list[Condition] = []
        inside = counts
        on_prune: list[tuple[int, int]] = []  # of each beginning of the rule
        while len(rule) < max_conditions:
            gain, condition, (_, wrong) = _grown(inside, cuts)
            if condition is None or gain < min_gain:
                break
            rule.append(condition)
            inside = _counts(left.where(covered(rule)))
            on_prune.append(_totals(inside, False))
            if not wrong:
                break
        if not rule:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in on_prune]
        rule = rule[: worth.index(max(worth)) + 1]
        if max(worth) <= 0:
            break
        out.rules.append(rule)
        left = left.where(~covered(rule))
        counts = _counts(left)
    binned.unpersist()
    known.unpersist()
    return out


def filter_kept(docs: DataFrame, rules: DecisionList, min_words: int = 50) -> DataFrame:
    """The rows of docs that pass the base rules and the list, with their own columns only; one narrow pass. The row
    number keeps the optimizer from moving the condition below the statistics, where each use would compute them anew."""
    stats = with_statistics(docs, prefix="__rules_").withColumn("__rules_row", F.monotonically_increasing_id())
    return stats.where(rules.kept("__rules_", min_words) & (F.col("__rules_row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
