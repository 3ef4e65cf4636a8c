"""Line-first cleaning rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import SPACE, WORD, free_name, settled

#: Fixed wording of the line rules; each is one regular expression that Java and RE2 read alike.
TERMINAL_MARKS = tuple(""".!?:;…。！？"'”’»)]""")
SOLID = r"[^\x20\x09-\x0D]"
SENTENCE_END = r"""[.!?。！？]["'”’)]?[\x20\x09-\x0D]"""
NAVIGATION = r"(?:[|»›•·→>][^|»›•·→>]*){3}"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept (?:all )?cookies"
    r"|click here|read more|sign (?:up|in) (?:now|here|for)|subscribe to our|enable javascript|skip to (?:main )?content"
    r"|share (?:this|on) (?:page|post|article|facebook|twitter)|back to top|lorem ipsum)\b"
)
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]{2}"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line goes: unlike prose in its punctuation, navigation, or boilerplate. Blank lines stay.

    Punctuation unlike prose: no sentence ends in it or with it, or over one symbol or
    doubled mark to ten words. Counts are taken only where a line has any mark at all.
    """
    marks = F.regexp_count(line, F.lit(SYMBOLS)) + F.regexp_count(line, F.lit(SHOUTS))
    ends = F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(*TERMINAL_MARKS)
    return line.rlike(SOLID) & (
        ~(ends | line.rlike(SENTENCE_END))
        | (line.rlike(f"{SYMBOLS}|{SHOUTS}") & (marks * 10 > F.regexp_count(line, F.lit(WORD))))
        | (line.rlike("[|»›•·→>]") & line.rlike(NAVIGATION)) | line.rlike(BOILERPLATE)
    )


def apply_rules(docs: DataFrame, max_lost_percent: int = 30, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """docs with a struct column `rules` (renamed with underscores if docs has one).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed,
    lost_chars (characters of words in removed lines), kept, and clean_text (the lines that
    stay, joined by line feeds; null where text is null). Null text counts as no words and so
    fails. Repeated rows are judged each by itself; an empty table gives an empty result. All
    work is within the row: nothing is shuffled, whatever the source or the copies.
    """
    name = free_name(docs, "rules")
    own = ("text", "words", "grams", "pairs", "lines", "fails", "solid", "starts", "n", "chars", "rep", "lost")
    t, w, g, p, lines, fails, solid, starts, n, chars, rep, lost = (free_name(docs, f"_{x}") for x in own)
    out = docs.withColumn(t, F.coalesce("text", F.lit("")))
    out = settled(out, {w: _words(F.col(t)), lines: F.split(t, "\n")})
    out = settled(out, {
        g: F.when(F.size(w) >= 5, F.transform(
            F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(5)])
        )),
        fails: F.transform(lines, line_fails),
        solid: F.filter(lines, lambda x: x.rlike(SOLID)),
    })
    # Windows found again: sort (hash, start) and keep entries that equal a neighbour.
    out = settled(out, {p: F.when(
        F.size(F.array_distinct(g)) < F.size(g),
        F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )})
    out = settled(out, {starts: F.sort_array(F.transform(
        F.filter(p, lambda x, k: (
            (x["h"] == F.get(F.col(p), k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(F.col(p), k - 1)["h"]))
        )),
        lambda x: x["i"],
    ))})
    zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    repeats = F.aggregate(starts, zero, lambda a, s: F.struct(
        s.alias("last"), (a["n"] + F.least(F.lit(5), s - a["last"])).alias("n")
    ), lambda a: a["n"])
    long = lambda c: c.cast("long")
    out = settled(out, {
        n: long(F.size(w)),
        chars: long(F.length(F.array_join(w, ""))),
        rep: F.coalesce(repeats, F.lit(0).cast("long")),
        lost: long(F.length(F.regexp_replace(F.array_join(F.filter(lines, lambda _, i: F.get(F.col(fails), i)), ""), SPACE, ""))),
    })
    failed = (F.col(n) < min_words) | (F.col(rep) * 100 > F.col(n) * max_repeat_percent)
    rules = F.struct(
        F.col(n).alias("n_words"), F.col(chars).alias("word_chars"),
        long(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size(solid) - F.size(F.array_distinct(solid))).alias("n_dup_lines"),
        F.col(rep).alias("n_repeat_words"), failed.alias("base_failed"), F.col(lost).alias("lost_chars"),
        (~failed & (F.col(lost) * 100 <= F.col(chars) * max_lost_percent)).alias("kept"),
        F.when(F.col("text").isNotNull(), F.array_join(F.filter(lines, lambda _, i: ~F.get(F.col(fails), i)), "\n")).alias("clean_text"),
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], rules.alias(name))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with their failing lines gone; n_chars follows the text where there is such a column."""
    name = free_name(docs, "rules")
    out = apply_rules(docs, **limits).where(F.col(f"{name}.kept"))
    new = {"text": F.col(f"{name}.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(f"{name}.clean_text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
