"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Null, empty or blank text: no words, every count 0, `base_failed` true, `kept` false. Repeated rows each get
their own result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "und",
    "von", "zu",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "con", "del", "el", "los", "las", "no", "o", "para", "por", "se", "su", "y",
)
MIN_WORDS = 10
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Passes if low <= metric <= high, in documents of at least min_words words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table of production. Ratios are per word, or per line with words.
RULES = (
    Rule("mean_word_chars", 1.5, 30.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("mark_ratio", None, 0.25),
    Rule("stop_ratio", 0.01, None, min_words=60),
    Rule("dup_line_ratio", None, 0.5, min_words=30),
    Rule("ellipsis_line_ratio", None, 0.5, min_words=30),
)


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 5-word window whose words occur again in the text, first occurrence included.

    Windows are compared by two rounds of 64-bit hashes. Texts without a repeated window stop after one
    linear pass; else the windows are sorted once and the covered positions counted as a union of intervals.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            tagged,
            lambda s: F.filter(
                s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            ),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct(
                (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda a: a["n"],
        )

    def windows(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashed) - WINDOW),
            lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(WINDOW))),
        )

    whole = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda hashed: let(
            windows(hashed),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        ),
    )
    return F.when(F.size(ws) > WINDOW, whole).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of the counts that rules and results are made of."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda ws: let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.concat_ws("", ws)).cast("long").alias("word_chars"),
                F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeat_words(ws).cast("long").alias("n_repeat_words"),
                F.regexp_count(body, F.lit(r"[!?~^=_+@{}\[\]\\]")).cast("long").alias("n_marks"),
                F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(ls, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
                .cast("long")
                .alias("n_ellipsis_lines"),
            ),
        ),
    )


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression over the struct of measures()."""
    n, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    metrics = {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "mark_ratio": m["n_marks"] / n,
        "stop_ratio": m["n_stop_words"] / n,
        "dup_line_ratio": m["n_dup_lines"] / lines,
        "ellipsis_line_ratio": m["n_ellipsis_lines"] / lines,
        "repeat_ratio": m["n_repeat_words"] / n,
    }
    passed = F.lit(True)
    for rule in rules:
        x = metrics[rule.metric]
        ok = F.lit(True)
        if rule.low is not None:
            ok &= x >= F.lit(float(rule.low))
        if rule.high is not None:
            ok &= x <= F.lit(float(rule.high))
        passed &= ok | (m["n_words"] < rule.min_words)
    return passed


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the measures with base_failed and kept, for use inside any projection."""

    def judge(m: Column) -> Column:
        names = (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words",
            "n_lines", "n_ellipsis_lines",
        )
        return F.struct(
            *(m[x].alias(x) for x in names),
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & compile_rules(m, rules)).alias("kept"),
        )

    return let(measures(text), judge)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """A row of measures and verdicts for each row of docs."""
    # the struct stands behind a barrier-free alias: explode of one element keeps Catalyst from copying it per field
    one = docs.select(F.col(id_col).alias(id_col), F.explode(F.array(verdict(F.col(text_col), rules))).alias("q"))
    return one.select(id_col, "q.*")


def keep(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that pass, with their columns as they are."""
    return docs.filter(verdict(F.col(text_col), rules)["kept"])
