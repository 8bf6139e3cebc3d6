"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is built-in expressions over one row; there is no user function and no shuffle. Words are runs
of characters other than white space (space, tab to carriage return).

Edge cases: a null or empty text has no words and fails; repeated rows are judged each; empty tables give
empty results; extra columns are not touched. Three-word windows are compared by their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of four languages.
STOP_WORDS = tuple(
    "the of and to in is was for with that on at by from this be are or as it he she they we you have has not but which an a "
    "de la le les des et un une que qui pour par sur dans au aux ou il elle est du ce se ne pas plus "
    "der die das und von mit ein eine ist nicht sich auch auf den dem zu im für als "
    "el los las y del por con para su al lo no es una como más".split()
)

#: Threshold table: rule, measure, least, most (None: open). A text is kept when every measure lies in its bounds.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("enough_words", "n_words", 50, None),
    ("word_length", "mean_word", 1.5, 25),
    ("symbols", "symbols_per_word", None, 0.25),
    ("stop_words", "stop_share", 0.01, None),
    ("repeated_lines", "dup_line_share", None, 0.9),
    ("repeated_words", "repeat_share", None, 0.5),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK, -1)).otherwise(F.array().cast("array<string>"))


def repeat_words(ws: Column) -> Column:
    """How many words lie in three-word windows that the text holds at least twice."""

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def positions(s):
        return F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])).alias("twice"))), lambda x: F.coalesce(x["twice"], F.lit(False))), lambda x: x["i"]))

    def from_hashes(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, lambda s: let(positions(s), covered)))

    def from_words(w):
        h = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(h, from_hashes))

    return let(ws, from_words)


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts the rules use, one row per input row."""
    value = F.coalesce(F.col(text), F.lit(""))

    def of_words(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(value, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    symbols = (F.length(value) - F.length(F.regexp_replace(value, SYMBOLS, ""))).cast("long")
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), let(words(value), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))
    return found.select("doc_id", "w.*", "l.*", "n_symbols")


def ratios() -> dict[str, Column]:
    """The measures of the threshold table over the columns of ``measure``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_share": F.col("n_stop_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    """Whether all rules of a threshold table hold, as one condition."""
    found, ok = ratios(), F.lit(True)
    for _, name, least, most in thresholds:
        if least is not None:
            ok = ok & (found[name] >= least)
        if most is not None:
            ok = ok & (found[name] <= most)
    return ok


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Counts, base_failed (under 50 words or over half of them in repeated windows) and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, doc_id=doc_id, text=text).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(thresholds))
