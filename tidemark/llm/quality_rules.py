"""Quality rules: a learned decision list over document statistics (DataFrame functions only).

Every whole text gets statistics of its words, symbols, lines and repetitions, in one look. Two
base rules are given: a text of under ``LEAST_WORDS`` words fails, and so does one of which over
``REPEATED`` percent of the words stand in a window of ``WINDOW`` words found twice or more.

What they pass goes to the learned list. Sequential covering: statistics of labelled documents are
cut at their quantiles, and a rule grows, one threshold at a time, by the gain of information over
the labelled rows that no earlier rule takes (two thirds of them); it's then pruned, last
condition first, on the other third, and joins the list if at least ``PRECISION`` of the rows that
it takes there are labelled bad. The list is an ordered Spark conditional expression: the first
rule that holds rejects, and a text that none takes is kept.

Each step of growing reads one histogram (statistics times cuts) from Spark, and learning looks at
about ``SAMPLE`` labelled rows (a share of the ids' hashes; a documented bound) grouped by their
cuts. Statistics are taken of all texts once and kept in the shared folder.

Repeated windows: words are hashed, and the hash of 8 words is put together from two of 4, and so
on. Only a text with an equal pair of windows sorts them; words in any of the repeated places are
counted from the places in order. All of it happens within a row, n log n in its words.

Cases: a null text has no words, so it fails the base; equal rows get equal results, as do rows
that share an id but not a text (each by its own text); a null id is kept as null and never
learned from; labels that are null are left out, and a document with several has their mean (under
one half: bad); without labels of both kinds there are no learned rules; an empty table gives an
empty result; other columns are left alone and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, Scratch, cut, hash_share

WINDOW = 8
LEAST_WORDS = 20
REPEATED = 30
SAMPLE = 50_000
CUTS = 31
CONDITIONS = 4
RULES = 24
PRECISION = 0.9
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOUD = "!?"
DIGITS = "0123456789"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _many(text: Column, marks: str) -> Column:
    """How many characters of the text are any of the marks."""
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("long")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: the lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _window_hashes(hashes: Column, n: Column) -> Column:
    """Of each place with a whole window behind it, by doubling: windows of 2, 4 and 8 words. What
    reaches beyond the end is cut off last."""

    def doubled(width: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(h, F.slice(h, width + 1, n), lambda a, b: F.xxhash64(a, b))

    whole = _once(_once(doubled(1)(hashes), doubled(2)), doubled(4))
    return F.slice(whole, 1, n - (WINDOW - 1))


def _covered(windows: Column, n: Column) -> Column:
    """Words inside windows whose hash is there twice or more. n: how many windows there are."""
    placed = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def of_sorted(rows: Column) -> Column:
        pairs = F.zip_with(F.slice(rows, 1, n - 1), F.slice(rows, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
        start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("upto"))

        def add(state: Column, at: Column) -> Column:
            fresh = F.lit(WINDOW) - F.greatest(F.lit(0), state["upto"] - at)
            return F.struct((state["words"] + fresh).alias("words"), (at + WINDOW).alias("upto"))

        return F.aggregate(places, start, add, lambda s: s["words"])

    return _once(placed, of_sorted)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, the five counts, and the other counts that rules may use, for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # words as one text with single spaces, so its length tells their characters
    said = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.trim(F.regexp_replace(text, f"[{BLANK}]+", " ")).alias("_said"))
    words = said.select("*", F.when(F.col("_said") == "", F.array().cast("array<string>")).otherwise(F.split("_said", " ")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    words = words.select("*", F.regexp_replace("_said", f"[^{SYMBOLS}{CAPITALS}{LOUD}{DIGITS}]+", "").alias("_marks"))
    counted = words.select(
        "_id",
        "_words",
        F.size("_words").alias("_n"),
        lines.alias("_lines"),
        F.when(F.col("_said") == "", F.lit(0)).otherwise(F.length("_said") - F.size("_words") + 1).cast("long").alias("word_chars"),
        *[_many(F.col("_marks"), marks).alias(name) for name, marks in (("n_symbols", SYMBOLS), ("n_capitals", CAPITALS), ("n_loud", LOUD), ("n_digits", DIGITS))],
        # ends of sentences; a replacement is cheaper than looking at each word
        (F.length("_said") - F.length(F.replace("_said", F.lit(". "), F.lit(" "))) + F.col("_said").endswith(".").cast("int")).cast("long").alias("n_stops"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    hashed = counted.select(
        "*",
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_kinds"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # one window can't be there twice
        F.when(F.col("_n") > WINDOW, _window_hashes(F.col("_hashes"), F.col("_n"))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    repeated = F.when(some, _covered(F.col("_windows"), F.size("_windows"))).otherwise(F.lit(0)).cast("long")
    return hashed.select("_id", F.col("_n").cast("long").alias("n_words"), *COUNTS[1:4], repeated.alias("n_repeat_words"), "n_capitals", "n_loud", "n_digits", "n_stops", "n_kinds", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def measures() -> dict[str, Column]:
    """What rules may ask for, by the name that they show."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "loud_per_word": _share("n_loud", "n_words"),
        "capitals_per_char": _share("n_capitals", "word_chars"),
        "digits_per_char": _share("n_digits", "word_chars"),
        "stops_per_word": _share("n_stops", "n_words"),
        "kinds_per_word": _share("n_kinds", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "dup_lines_per_line": _share("n_dup_lines", "n_lines"),
        "repeats_per_word": _share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """measure >= cut, or measure < cut."""

    measure: str
    cut: float
    above: bool

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.cut:.6g}"

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.measure] >= self.cut if self.above else of[self.measure] < self.cut


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, rule))}" for k, rule in enumerate(self.rules, 1)) or "keep all"

    def first_rule(self, of: dict[str, Column] | None = None) -> Column:
        """The text of the first rule that holds, or null: one ordered conditional expression."""
        of = of or measures()
        out = F.when(F.lit(False), F.lit(""))
        for rule in self.rules:
            out = out.when(reduce(Column.__and__, [c.column(of) for c in rule]), F.lit(" and ".join(map(str, rule))))
        return out


def _gain(p: float, n: float, before: tuple[float, float]) -> float:
    """Bits gained on the bad rows that stay, over the share of bad rows before."""
    return p * (math.log2(p / (p + n)) - math.log2(before[0] / sum(before))) if p else 0.0


class Grower:
    """Rows of cuts (for each measure, how many of its cuts a row reaches), bad and good rows."""

    def __init__(self, rows: DataFrame, cuts: dict[str, list[float]]):
        self.rows, self.cuts = rows, cuts

    def holds(self, c: Condition) -> Column:
        at = F.col(f"c_{c.measure}")
        place = self.cuts[c.measure].index(c.cut) + 1
        return at >= place if c.above else at < place

    def histogram(self, rows: DataFrame) -> dict[str, list[list[float]]]:
        """Per measure and number of cuts reached: bad and good rows."""
        each = F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"c_{m}").alias("at")) for m in self.cuts]))
        counted = rows.select("bad", "good", each).groupBy("m", "at").agg(F.sum("bad"), F.sum("good")).collect()
        out = {m: [[0.0, 0.0] for _ in range(len(c) + 1)] for m, c in self.cuts.items()}
        for m, at, bad, good in counted:
            out[m][at] = [float(bad), float(good)]
        return out

    def best(self, rows: DataFrame) -> tuple[Condition | None, tuple[float, float], tuple[float, float]]:
        """The condition of the highest gain (ties: first measure, lower cut), with the bad and
        good rows it takes and those there were."""
        found, gain, takes, before = None, 1e-9, (0.0, 0.0), (0.0, 0.0)
        for m, bins in self.histogram(rows).items():
            bad, good = (sum(b[k] for b in bins) for k in (0, 1))
            before = (bad, good)
            if not bad:
                return None, takes, before
            low = [0.0, 0.0]
            for cut_at, b in zip(self.cuts[m], bins, strict=False):
                low = [low[0] + b[0], low[1] + b[1]]
                for above, (p, n) in ((False, low), (True, (bad - low[0], good - low[1]))):
                    if (g := _gain(p, n, before)) > gain:
                        found, gain, takes = Condition(m, cut_at, above), g, (p, n)
        return found, takes, before

    def grown(self, rows: DataFrame, most: int) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < most:
            condition, takes, _ = self.best(rows)
            if condition is None:
                break
            rule.append(condition)
            rows = rows.where(self.holds(condition))
            if not takes[1]:
                break
        return rule

    def taken(self, rows: DataFrame, rule: list[Condition]) -> list[tuple[float, float]]:
        """Bad and good rows that the first 1, 2, ... conditions take."""
        asked = []
        for k in range(1, len(rule) + 1):
            inside = reduce(Column.__and__, [self.holds(c) for c in rule[:k]])
            asked += [F.coalesce(F.sum(F.when(inside, F.col(x))), F.lit(0)) for x in ("bad", "good")]
        row = rows.agg(*asked).first()
        return [(float(row[k]), float(row[k + 1])) for k in range(0, len(row), 2)]


def _pruned(rule: list[Condition], takes: list[tuple[float, float]]) -> tuple[list[Condition], float]:
    """The shortest beginning of the highest (bad - good) / (bad + good), and its precision."""
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in takes]
    k = worth.index(max(worth))
    p, n = takes[k]
    return rule[: k + 1], p / (p + n) if p + n else 0.0


def learn(statistics: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, precision: float = PRECISION) -> DecisionList:
    """The list from labelled rows of statistics (as with_statistics gives them)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = cut(known.groupBy(F.col(id_col).alias("_doc")).agg((F.avg(F.col(label_col).cast("double")) < 0.5).alias("_bad")))
    few = F.broadcast(cut(known.where(hash_share(F.col("_doc"), sample, known.count())).limit(2 * sample)))  # bounded
    of = measures()
    rows = statistics.where(~base_failed()).join(few, F.col("_id") == F.col("_doc"))
    rows = cut(rows.select("_bad", (F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(3)) == 0).alias("_check"), *[c.alias(m) for m, c in of.items()]))
    places = F.array(*[F.lit(k / (CUTS + 1)) for k in range(1, CUTS + 1)])
    quantiles = rows.groupBy("_bad").agg(*[F.percentile_approx(m, places, 10_000).alias(m) for m in of]).collect()
    if len(quantiles) < 2:
        return DecisionList()
    # cuts where bad rows lie and where good ones do
    cuts = {m: sorted({x for row in quantiles for x in row[m]}) for m in of}
    reached = [sum(((F.col(m) >= x).cast("int") for x in c), F.lit(0)).alias(f"c_{m}") for m, c in cuts.items()]
    grouped = rows.select("_bad", "_check", *reached).groupBy("_check", *[f"c_{m}" for m in cuts])
    table = cut(grouped.agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good")).coalesce(4))
    grower, out = Grower(table, cuts), DecisionList()
    left = table
    while len(out.rules) < RULES:
        rule = grower.grown(left.where("NOT _check"), CONDITIONS)
        if not rule:
            break
        takes = grower.taken(left.where("_check"), rule)
        if not any(map(sum, takes)):  # nothing to prune on: too few rows
            takes = grower.taken(left, rule)
        rule, sure = _pruned(rule, takes)
        if sure < precision:
            break
        out.rules.append(tuple(rule))
        left = left.where(~reduce(Column.__and__, map(grower.holds, rule)))
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """Per row: its id, the five counts, base_failed, kept, and the rule that rejects it if any."""
    scratch = Scratch(docs.sparkSession)
    statistics = scratch.keep(with_statistics(docs, id_col, text_col), "statistics")
    rules = learn(statistics, labels, id_col=id_col, label_col=label_col, **options)
    named = statistics.select("*", base_failed().alias("base_failed"), rules.first_rule().alias("_rule"))
    shown = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.col("_rule"))
    result = cut(named.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & F.col("_rule").isNull()).alias("kept"), shown.alias("rule")))
    scratch.drop()
    return result


def kept_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The rows of docs that base and list keep, as they are. Texts are looked at twice: once for
    all statistics that rules are learned from, once for the verdict of each row."""
    scratch = Scratch(docs.sparkSession)
    rules = learn(scratch.keep(with_statistics(docs, id_col, text_col), "statistics"), labels, id_col=id_col, label_col=label_col, **options)
    scratch.drop()
    whole = docs.select(F.struct("*").alias("_doc"))
    inner = with_statistics(whole.select("_doc", F.col("_doc").getField(text_col).alias("_t")), "_doc", "_t")
    good = inner.where(~base_failed() & rules.first_rule().isNull())
    return good.select(*[F.col("_id").getField(c).alias(c) for c in docs.columns])
