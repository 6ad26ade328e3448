"""Line-first quality rules, in Spark SQL functions only.

Every line is judged on its own (punctuation, navigation, boilerplate);
failing lines are removed, and a document that loses too many of its words is
rejected, as is one that fails the base rules.

``assess`` adds one struct column, so no column of the input can clash:

* ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (base),
* ``base_failed``, ``kept``, ``n_kept_words``, ``n_failed_lines``,
* ``clean_text``: the text without its failing lines.

Defined results: a null text counts as empty (0 words, so ``base_failed``);
blank lines never fail and are not duplicates; texts are read whole; equal
rows get equal verdicts; a null ``doc_id`` is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
WHITE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"
SEPARATORS = "[|»›•·]"
COUNTED = "[#*$%&|<>!?»›•·]"
BOILERPLATE = (
    "[Aa]ll rights reserved|[Cc]ookie policy|[Pp]rivacy policy|[Tt]erms of (use|service)|[Ee]nable [Jj]ava[Ss]cript|"
    "[Ll]orem ipsum|[Cc]lick here|[Rr]ead more|[Ss]ign up|[Ll]og in|[Ss]ubscribe|([Ll]icensed|[Rr]eleased) under the"
)
TERMINAL = (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？")
STRUCT = "quality"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _from(array: str, start: int) -> Column:
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))


def line_fails(line: Column, fragment_words: int = 4, boilerplate_chars: int = 160) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rules remove.

    * punctuation: over a tenth of the characters are symbols or ``!?`` marks
      (a line of one word may be a mark), or fewer than ``fragment_words``
      words without a closing mark;
    * navigation: three separators or more, one per four words at least;
    * boilerplate: a stock phrase in a line of ``boilerplate_chars`` at most.
    """
    chars, words = F.length(line), F.size(_words(line))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 10 > chars
    marks = (F.regexp_count(line, F.lit(MARKS)) * 10 > chars) & (words > 1)
    fragment = ~F.right(F.rtrim(line), F.lit(1)).isin(*TERMINAL) & (
        words < fragment_words)
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (bars >= 3) & (bars * 4 >= words)
    boilerplate = (chars <= boilerplate_chars) & line.rlike(BOILERPLATE)
    # Most lines hold none of these characters and skip the three counts.
    counted = line.rlike(COUNTED) & (symbols | marks | navigation)
    return line.rlike(INK) & (counted | fragment | boilerplate)


def assess(df: DataFrame, text_col: str = "text", min_kept_share: float = 0.5, min_words: int = 10,
           max_repeat_pct: int = 20, name: str = STRUCT) -> DataFrame:
    """``df`` with one struct column of counts, verdict and cleaned text.

    Repeated 5-word windows are found per text: window hashes are sorted with
    their positions, equal neighbours are repeats, and each start covers the
    words up to the next start, five at most.
    """
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One projection per step: each array is built once per text.
    step = held.select("row", "text", _words(F.col("text")).alias("words"), F.split("text", "\n").alias("all_lines"))
    step = step.select("row", "text", F.size("words").cast("long").alias("n"),
                       F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                       F.zip_with(F.zip_with("words", _from("words", 2), lambda a, b: F.xxhash64(a, b)),
                                  _from("words", 3), lambda p, w: F.xxhash64(p, w)).alias("threes"),
                       F.size("all_lines").cast("long").alias("n_lines"),
                       F.filter("all_lines", lambda s: s.rlike(INK)).alias("lines"),
                       F.filter("all_lines", lambda s: ~line_fails(s)).alias("good"))
    # Hash of each 5-word window from the hashes of its two overlapping 3-word halves.
    step = step.withColumn("win", F.when(F.col("n") >= 5, F.zip_with(
        F.slice("threes", 1, F.col("n").cast("int") - 4), F.slice("threes", 3, F.col("n").cast("int") - 4),
        lambda a, b: F.xxhash64(a, b))))
    step = step.withColumn("sorted", F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("at", F.sort_array(F.filter(F.transform(
        "sorted", lambda x, i: F.when(
            F.coalesce(F.get("sorted", i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda x: x.isNotNull())))
    step = step.withColumn("repeat", F.coalesce(F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(5), F.coalesce(F.get("at", i + 1), x + 5) - x)),
        F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    failed = (F.col("n") < min_words) | (F.col("repeat") * 100 > F.col("n") * max_repeat_pct)
    lost = F.col("n_lines") - F.size("good")
    step = step.withColumn("lost", lost.cast("long")).withColumn("good_words", F.when(lost == 0, F.col("n")).otherwise(
        F.aggregate("good", F.lit(0), lambda a, s: a + F.size(_words(s)))).cast("long"))
    verdict = F.struct(
        F.col("n").alias("n_words"), "word_chars",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (F.col("good_words") >= F.col("n") * min_kept_share)).alias("kept"),
        F.col("good_words").alias("n_kept_words"), F.col("lost").alias("n_failed_lines"),
        F.when(F.col("lost") == 0, F.col("text")).otherwise(F.array_join("good", "\n")).alias("clean_text"))
    # The verdict passes a generator (one row each): a caller's filter on it stays above.  Pushed into
    # the steps, it would copy their array expressions into one another beyond what the planner finishes.
    return step.select("row.*", F.explode(F.array(verdict)).alias(name))
