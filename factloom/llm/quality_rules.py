"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` are columns computed from the text alone; ``RULES`` is the table of thresholds on
them; ``judge`` compiles both into one ``select``. A new rule is a new row of the table.

Defined cases: null text counts as empty and has no words (n_words 0 fails the base rule); an
empty table gives an empty result; ids may repeat or be null; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as Java and RE2 both read it, and as plain characters.
WORD_BREAK, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for",
    "der", "die", "das", "und", "den", "mit", "von", "zu", "ist", "nicht", "ein", "im",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "en", "est", "pour",
    "el", "los", "las", "que", "y", "del", "se", "por", "con", "una", "su", "para",
)


def stop_forms() -> list[str]:
    """Stop words as they stand inside and at the beginning of a sentence."""
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


class Rule(NamedTuple):
    """``measure`` must lie in [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("too_few_words", "n_words", 50, None),
    Rule("too_many_words", "n_words", None, 2_000_000),
    Rule("short_words", "mean_word_chars", 2.0, None),
    Rule("long_words", "mean_word_chars", None, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.4),
    Rule("repeated_windows", "repeat_word_ratio", None, 0.5),
    Rule("few_stop_words", "stop_word_count", 2, None),
    Rule("shouting", "upper_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.translate(text, drop, "")).cast("long")


#: Texts with more distinct repeated windows than this take the sorting route.
FEW = 48


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside three-word windows that stand at least twice in ``words``.

    ``hashes`` has a 64-bit hash of every window. Sorting them makes equal ones neighbours, which
    gives the repeated ones. Where they are few, each window looks itself up among them; where
    they are many, every window becomes a string "a b c index" and the sorted strings give the
    repeated starts (words hold no space). The starts then cover 3 words each, less where the
    next start is nearer.
    """
    n = F.size(words)
    neighbours = lambda x, f: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), f)
    known = lambda x: F.filter(x, lambda v: v.isNotNull())
    none = F.array().cast("array<int>")

    def by_lookup(twice: Column) -> Column:
        return known(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)))

    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), i.cast("string"))
    start = lambda k: F.substring_index(k, " ", -1).cast("int")
    body = lambda k: F.substring_index(k, " ", 3)

    def by_sorting() -> Column:
        keyed = F.array(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
        pairs = F.transform(keyed, lambda k: neighbours(k, lambda a, b: F.when(body(a) == body(b), F.array(start(a), start(b)))))
        return F.sort_array(F.array_distinct(F.flatten(known(F.get(pairs, F.lit(0))))))

    def starts(twice: Column) -> Column:
        return F.when(F.size(twice) == 0, none).when(F.size(twice) <= FEW, by_lookup(twice)).otherwise(by_sorting())

    def covered(at: Column) -> Column:
        gaps = neighbours(at, lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))

    # each value that is used twice is bound by a one-item transform, so it is made once
    ordered = F.array(F.sort_array(hashes))
    twice = F.transform(ordered, lambda h: F.array_distinct(known(neighbours(h, lambda a, b: F.when(a == b, a)))))
    total = F.get(F.transform(F.transform(twice, starts), covered), F.lit(0))
    return F.when(n < 4, F.lit(0)).otherwise(total).cast("long")


def measures(documents: DataFrame) -> DataFrame:
    """doc_id and all measures, in one projection over the text and one over its parts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    parts = documents.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    many = F.when(F.size("words") >= 4, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    parts = parts.withColumn("hashes", F.transform(many, window))
    n_words, n_lines = F.size("words").cast("long"), F.size("lines").cast("long")
    ratio_of = lambda test: _ratio(F.size(F.filter("lines", test)), n_lines)
    base = parts.select(
        "doc_id",
        n_words.alias("n_words"),
        _kept_chars(F.col("text"), BLANKS).alias("word_chars"),
        (F.length("text") - _kept_chars(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("hashes")).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, stop_forms())))).cast("long").alias("stop_word_count"),
        (F.length("text") - _kept_chars(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
        (F.length("text") - _kept_chars(F.col("text"), "abcdefghijklmnopqrstuvwxyz")).cast("long").alias("n_lower"),
        ratio_of(lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("• ")).alias("bullet_line_ratio"),
        ratio_of(lambda x: x.endswith("...") | x.endswith("…")).alias("ellipsis_line_ratio"),
    )
    return base.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
            "upper_ratio": _ratio(F.col("n_upper"), F.col("n_upper") + F.col("n_lower")),
        }
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the broken rules, as one expression."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measures(documents).withColumn("base_failed", base).withColumn("broken", compile_rules(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


ORACLE = """
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base
), win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS t(d) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_intersect(words, [{stops}])) AS stop_word_count,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
    len(list_filter(lines, lambda x: starts_with(ltrim(x, ' '), '- ') OR starts_with(ltrim(x, ' '), '* ') OR starts_with(ltrim(x, ' '), '• '))) AS n_bullets,
    len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_dots
  FROM w LEFT JOIN cov USING (r)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 50 AND 2000000
  AND word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words AND n_symbols / n_words::DOUBLE <= 0.2
  AND (n_lines = 0 OR n_dup_lines / n_lines::DOUBLE <= 0.4) AND n_repeat_words / n_words::DOUBLE <= 0.5
  AND stop_word_count >= 2 AND (n_upper + n_lower = 0 OR n_upper / (n_upper + n_lower)::DOUBLE <= 0.5)
  AND (n_lines = 0 OR (n_bullets / n_lines::DOUBLE <= 0.9 AND n_dots / n_lines::DOUBLE <= 0.5)) AS kept
FROM f
""".replace("{stops}", ", ".join(f"'{w}'" for w in stop_forms()))
