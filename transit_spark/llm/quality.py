"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every figure comes from arrays made inside the row, so nothing is shuffled and a text is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transit_spark.llm.common import SPACE_CLASS, WHITE_SPACE, WORD_PATTERN, keyed

#: Frequent function words of four languages.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der die ein eine ist mit nicht sich und von zu im "
    "dans de des du elle en est et la le les ou par pas pour que qui un une "
    "con del el las los no para por se su y"
).split()

#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` lies outside ``least`` and ``most``; a NULL measure passes."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        outside = F.lit(False)
        if self.least is not None:
            outside = outside | (F.expr(self.measure) < self.least)
        if self.most is not None:
            outside = outside | (F.expr(self.measure) > self.most)
        return F.coalesce(outside, F.lit(False))


#: The table of thresholds. Measures are SQL over the figures of ``measured``.
RULES = (
    Rule("too_few_words", "n_words", least=10),
    Rule("word_length", "word_chars / nullif(n_words, 0)", least=2, most=15),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", most=0.3),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", least=0.02),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", most=0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / nullif(n_lines, 0)", most=0.3),
    Rule("bullet_lines", "n_bullet_lines / nullif(n_lines, 0)", most=0.9),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of every text; NULL and empty texts have zeros.

    ``n_repeat_words`` are the words inside 5-word windows found twice or more in the text. Most texts are settled
    by counting the distinct hashes of their windows: equal windows have equal hashes, so as many hashes as windows
    means that none repeats. The others sort their windows themselves, so the figure is exact.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = f"filter(split(text, '[{SPACE_CLASS}]+', -1), w -> w <> '')".replace("\\", "\\\\")
    worded = f"[^{SPACE_CLASS}]".replace("\\", "\\\\")
    lines = f"filter(split(text, '\\n', -1), l -> l rlike '{worded}')".replace("'\\n'", "'\\\\n'")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    hashes = """if(size(words) < 5, array(), transform(sequence(0, size(words) - 5),
        i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])))"""
    windows = """if(size(array_distinct(hashes)) = size(hashes), array(), sort_array(transform(sequence(0, size(words) - 5),
        i -> struct(concat_ws(' ', slice(words, i + 1, 5)) as window, i as i))))"""
    repeated = """sort_array(transform(filter(windows, (x, j) ->
        (j > 0 and windows[j - 1].window = x.window) or (j < size(windows) - 1 and windows[j + 1].window = x.window)), x -> x.i))"""
    covered = """aggregate(repeated, struct(-5 as last, 0L as n),
        (acc, i) -> struct(i as last, acc.n + least(5, i - acc.last) as n)).n"""
    return (
        keyed(docs, id_col, text_col)
        .withColumn("text", text)
        .withColumn("words", F.expr(words))
        .withColumn("lines", F.expr(lines))
        .withColumn("hashes", F.expr(hashes))
        .withColumn("windows", F.expr(windows))
        .withColumn("repeated", F.expr(repeated))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("text", WHITE_SPACE, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr(covered).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.expr(f"size(filter(words, w -> lower(w) in ({stops})))").cast("long").alias("n_stop_words"),
            F.expr("size(filter(words, w -> endswith(w, '!!')))").cast("long").alias("n_shouts"),
            F.expr("size(filter(lines, l -> endswith(rtrim(l), '...') or endswith(rtrim(l), '…')))").cast("long").alias("n_ellipsis_lines"),
            F.expr("size(filter(lines, l -> startswith(ltrim(l), '- ') or startswith(ltrim(l), '* ') or startswith(ltrim(l), '•')))")
            .cast("long")
            .alias("n_bullet_lines"),
        )
    )


def judged(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``failed_rules`` in one projection made from the table."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules]))
    return (
        figures.withColumn("base_failed", base)
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Figures and verdict for every document."""
    return judged(measured(docs, id_col, text_col), rules)
