"""Quality rules (operator 8): line-first cleaning, in DataFrame functions only.

Every line that has a word is judged by three rules; lines that fail one are removed, and a
document that loses too much of its text that way is rejected:

* punctuation: the line ends like a sentence or holds sentence marks often enough, and is not
  littered with symbols;
* navigation: the line is not a chain of menu entries;
* boilerplate: the line holds none of the phrases that pages repeat (script and cookie notices).

Cases: a null text is empty; an empty text has no words, loses nothing and fails the base rule
(fewer than 50 words). Rows are judged one by one, so ties and repeated rows stay as they are;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read: other columns, also
ones named like an output column, do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, whole_text, words

SYMBOLS = "#*$%&|<>"
NAVIGATION_MARKS = "|»›•"
# phrases of page furniture, compared in lower case
BOILERPLATE = (
    "javascript is disabled", "enable javascript", "this site uses cookies", "we use cookies", "cookie policy",
    "terms of use", "terms of service", "privacy policy", "all rights reserved", "lorem ipsum", "skip to content",
    "click here to", "sign up for our newsletter",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the cleaning."""

    words_per_mark: int = 50  # a line without a final mark needs one sentence mark per so many words
    symbol_percent: int = 10  # of a line's characters
    navigation_marks: int = 2  # so many make a menu
    min_kept_percent: int = 50  # of the document's words
    min_words: int = 50
    repeat_percent: int = 50


RULES = LineRules()


def _n_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _has_word(line: Column) -> Column:
    return F.trim(F.translate(line, ASCII_SPACE[1:], " " * 5)) != ""


def line_passes(line: Column, rules: LineRules = RULES) -> Column:
    """The verdict on one line that has a word."""
    blank = F.translate(line, ASCII_SPACE[1:], " " * 5)

    def judge(trimmed: Column) -> Column:
        low = F.lower(trimmed)
        spaces = _n_of(trimmed, " ")
        ends = trimmed.rlike("[.!?…。！？][\"'”’»)\\]]*$")
        marks = _n_of(trimmed, ".!?…。！？")
        no_phrase = F.lit(True)
        for phrase in BOILERPLATE:
            no_phrase = no_phrase & ~F.contains(low, F.lit(phrase))
        return ((ends | (marks * rules.words_per_mark > spaces))
                & (_n_of(trimmed, SYMBOLS) * 100 <= F.length(trimmed) * rules.symbol_percent)
                & (_n_of(trimmed, NAVIGATION_MARKS) < rules.navigation_marks)
                & no_phrase)

    return let(F.trim(blank), judge)


def clean_text(text: Column, rules: LineRules = RULES) -> Column:
    """The text without its failing lines; lines without a word stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda l: ~_has_word(l) | line_passes(l, rules)), "\n")


def repeat_words(ws: Column, n: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Most texts have no such window, which a hash set shows; the others sort their windows with
    their positions, so the work is n log n also for a text that repeats one word."""
    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))

    windows = F.transform(F.sequence(F.lit(0), n - 3), window)

    def covered(sorted_: Column) -> Column:
        m = F.size(sorted_)
        same = F.zip_with(F.slice(sorted_, F.lit(1), m - 1), F.slice(sorted_, F.lit(2), m - 1),
                          lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        places = F.flatten(F.filter(same, lambda p: p.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def count(wins: Column) -> Column:
        placed = F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(let(F.sort_array(placed), covered))

    return F.when(n < 4, 0).otherwise(let(windows, count)).cast("long")


def judge(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """One row per document: its measures, the verdict and the cleaned text."""
    text = whole_text()
    base = docs.select(F.col("doc_id"), text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), _has_word)
    # one struct per row, so that words and lines are built once
    measured = base.select(
        "doc_id", "text",
        let(words(F.col("text")), lambda ws: let(F.size(ws), lambda n: F.struct(
            n.cast("long").alias("n_words"), repeat_words(ws, n).alias("n_repeat_words")))).alias("w"),
        (F.length("text") - _n_of(F.col("text"), ASCII_SPACE)).cast("long").alias("word_chars"),
        _n_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        clean_text(F.col("text"), rules).alias("clean"))
    out = measured.select(
        "doc_id", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.when(F.col("clean") == F.col("text"), F.col("w.n_words"))
        .otherwise(F.size(words(F.col("clean")))).cast("long").alias("n_kept_words"), "clean")
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("n_kept_words") >= rules.min_kept_percent * F.col("n_words")))


def clean(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """The documents that stay, with their failing lines removed: the columns of ``docs``
    (``n_chars`` follows the text where it is there)."""
    kept = judge(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), rules).filter("kept")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(F.col("clean") == F.coalesce(F.col("doc_id.text"), F.lit("")),
                               F.col("doc_id.text")).otherwise(F.col("clean")).alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            cols.append(F.when(F.col("clean") == F.col("doc_id.text"), F.col("doc_id.n_chars"))
                        .otherwise(F.length("clean").cast(kind)).alias("n_chars"))
        else:
            cols.append(F.col(f"doc_id.`{c}`").alias(c))
    return kept.select(*cols)


_JUDGED_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
m AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
j AS (SELECT k, line, regexp_replace(regexp_replace(line, '[\x09-\x0D]', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM l),
v AS (SELECT k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
       (regexp_matches(t, '[.!?…。！？]["''”’»)\]]*$')
        OR len(regexp_extract_all(t, '[.!?…。！？]')) * 50 > len(regexp_extract_all(t, ' ')))
       AND len(regexp_extract_all(t, '[#*$%&|<>]')) * 100 <= length(t) * 10
       AND len(regexp_extract_all(t, '[|»›•]')) < 2
       AND NOT regexp_matches(lower(t), '{phrases}') AS ok FROM j),
kw AS (SELECT k, coalesce(sum(n) FILTER (ok), 0) AS n_kept_words FROM v GROUP BY k),
win AS (SELECT k, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM m)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, i + unnest([0, 1, 2]) AS p FROM dup) GROUP BY k),
o AS (SELECT k, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(n_kept_words, 0) AS n_kept_words
      FROM m LEFT JOIN rep USING (k) LEFT JOIN kw USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept
FROM o"""
ORACLE_SQL = _JUDGED_SQL.replace("{phrases}", "|".join(BOILERPLATE))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return judge(read(spark, sf_dir, "documents")).drop("clean", "n_kept_words")
