r"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are maximal runs of ``[^\x20\x09-\x0D]``. A null or empty text has no words, zero counts and fails the base rule.
Repeated rows are judged alike, row by row. Columns of the input stay unless ``columns`` picks some; measures come in
columns of the prefix ``_q_``. A column of the input that has such a name stays, and the measure gets underscores after its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_RUN, SEPARATORS, beside, free

SYMBOLS = "#*$%&|<>"

#: Before the names of the counts.
Q = "_q_"
#: Windows of a text whose places fit into the low bits of a long.
PLACE_BITS = 12
PACKED = 1 << PLACE_BITS

#: Frequent function words of the four languages that the rules were set for.
STOP_WORDS = tuple(
    """the of and to in a is that it for on was as with be by are this at an from or which have not
    de la le les des et en un une du est que qui dans pour par sur au aux avec pas ne se
    der die das und zu den mit von ist im auf für nicht ein eine sich dem des als auch es
    el los las y del se por con una para su al lo como más no o""".split()
)


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose measure lies between ``least`` and ``most`` (None: no bound)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The table. ``mean_word_chars`` .. ``dup_line_ratio`` are the names that ``ratios`` defines.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("marks", "mark_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.01, None),
    Rule("line_repeats", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")
_USED = ("_t", "_w", "_l", "_k", "_h", "_s", "_x", "_row")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_q_*``: the counts that rules are made of."""
    return beside(df, [Q + c for c in COUNTS], _USED, lambda inner, name: _measured(inner, name(text)))


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_q_*``: the counts that rules are made of. They are columns of their own, not fields of a struct, because the optimiser
    copies a struct's expressions to wherever its fields are used.

    The windows of three words are told apart by a hash; sorting (hash, place) puts equal windows side by side, in n log n time
    within the row and without a shuffle. Up to ``PACKED`` windows, 52 bits of the hash and the place share one long, which sorts
    faster (odds of a false repeat below 2e-9 a text); beyond it all 64 bits and the place form a struct.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = df.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", SEPARATOR_RUN), ""))
    a = a.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("_w")
    a = a.withColumn("_k", F.transform("_w", lambda x: F.xxhash64(x)))
    k = F.col("_k")
    windows = F.transform(k, lambda x, i: F.xxhash64(x, F.get(k, i + 1), F.get(k, i + 2)))
    a = a.withColumn("_h", F.slice(windows, F.lit(1), F.greatest(F.size("_k") - 2, F.lit(0))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    few = F.size("_h") <= PACKED
    top = lambda x: F.shiftright(x, PLACE_BITS)
    packed = F.sort_array(F.transform("_h", lambda x, i: F.shiftleft(top(x), PLACE_BITS).bitwiseOR(i.cast("long"))))
    whole = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    a = a.withColumn("_s", F.when(twice & few, packed)).withColumn("_x", F.when(twice & ~few, whole))
    s, x_ = F.col("_s"), F.col("_x")
    equal = F.filter(s, lambda x, i: (top(F.get(s, i - 1)) == top(x)) | (top(F.get(s, i + 1)) == top(x)))
    places = F.transform(equal, lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int"))
    equal = F.filter(x_, lambda x, i: (F.get(x_, i - 1)["h"] == x["h"]) | (F.get(x_, i + 1)["h"] == x["h"]))
    starts = F.sort_array(F.coalesce(places, F.transform(equal, lambda x: x["p"])))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda z, p: F.struct(p.alias("last"), (z["n"] + F.least(F.lit(3), p - z["last"])).alias("n")),
        lambda z: z["n"],
    )
    line = F.col("_l")

    def ellipsis(x: Column) -> Column:
        end = F.rtrim(x, F.lit(SEPARATORS))
        return end.endswith("...") | end.endswith("…")

    long = lambda c: c.cast("long")
    return a.withColumns(
        {
            Q + "n_words": long(F.size("_w")),
            Q + "word_chars": long(F.char_length(F.array_join("_w", ""))),
            Q + "n_symbols": long(F.regexp_count("_t", F.lit(f"[{SYMBOLS}]"))),
            Q + "n_marks": long(F.char_length("_t") - F.char_length(F.replace("_t", F.lit("!"), F.lit("")))),
            Q + "n_stop_words": long(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))),
            Q + "n_lines": long(F.size("_l")),
            Q + "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
            Q + "n_bullet_lines": long(F.size(F.filter(line, lambda x: x.rlike(r"^\s*([-*•]|\d+[.)])\s")))),
            Q + "n_ellipsis_lines": long(F.size(F.filter(line, ellipsis))),
            Q + "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_t", "_w", "_l", "_k", "_h", "_s", "_x")


def measure(name: str) -> Column:
    return F.col(Q + name)


def ratios() -> dict[str, Column]:
    """The measures that rules may name. A ratio over nothing is 0."""

    def over(a: str, b: str) -> Column:
        return F.when(measure(b) > 0, measure(a) / measure(b)).otherwise(F.lit(0.0))

    return {
        "n_words": measure("n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "mark_ratio": over("n_marks", "n_words"),
        "stop_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
    }


def base_failed() -> Column:
    return (measure("n_words") < 50) | (100 * measure("n_repeat_words") > 50 * measure("n_words"))


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that the measures break, in the table's order."""
    by = ratios()
    broken = []
    for r in rules:
        out = F.lit(False)
        if r.least is not None:
            out = out | (by[r.measure] < r.least)
        if r.most is not None:
            out = out | (by[r.measure] > r.most)
        broken.append(F.when(out, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``_q_*`` (the counts) and ``_failed`` (names of broken rules; ``base`` first if the base rule is broken)."""
    return beside(df, [*(Q + c for c in COUNTS), "_failed"], _USED, lambda inner, name: _judged(inner, name(text), rules))


def _judged(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    base = F.when(base_failed(), F.array(F.lit("base"))).otherwise(F.array().cast("array<string>"))
    return _measured(df, text).withColumn("_failed", F.concat(base, failed_rules(rules)))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that break no rule, with the columns they came with.

    The optimiser would move the filter below the projections and so copy each measure's expression into it many times over; a row
    number, which no filter may pass, holds it above them.
    """
    row = free(df.columns, "_row")
    failed = F.col(free(df.columns, "_failed"))
    out = judged(df, text, rules).withColumn(row, F.monotonically_increasing_id())
    return out.filter((F.size(failed) == 0) & (F.col(row) >= 0)).select(*["`" + c.replace("`", "``") + "`" for c in df.columns])
