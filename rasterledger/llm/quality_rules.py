"""Quality rules: a table of thresholds compiled into Spark projections.

Everything is built-in functions on one row; no shuffle and no user function.
A first projection cuts the text into words and lines, a second one counts, and
the last one holds the compiled table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rasterledger.llm.texts import spare

#: A word is a run of other than these (blank and the controls from tab to return).
SPACES = r"[\x20\x09-\x0D]"
#: Words of a window, and how often a window must be found.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Languages whose frequent words are known; texts of others are not judged by them.
LANGUAGES = ("en", "de", "es", "fr")
# Frequent words of these languages. Fixed values.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht sich und von zu "
    "con de del el en es la las los no para por que se su un una y "
    "au aux avec ce dans des du elle est et il le les ne pas pour qui sur"
).split()


class Rule(NamedTuple):
    """Allowed range of a measure; None leaves that side open.

    With ``languages`` the rule applies to texts of these languages alone.
    """

    name: str
    measure: str
    least: float | None
    most: float | None
    languages: tuple[str, ...] | None = None


#: Length, symbols, stop words and lines. A text that breaks one is not kept.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop_words / n_words", 0.02, None, LANGUAGES),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside windows that are found twice or more, from the hash of each window."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Equal hashes are neighbours now: compare each entry with the one before and the one after.
    before = F.zip_with(
        ranked,
        F.concat(F.slice(ranked, 1, 0), F.array(F.lit(None)), ranked),
        lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), (x["h"] == y["h"]).alias("same")),
    )
    both = F.zip_with(
        before,
        F.slice(ranked, 2, 2**31 - 2),
        lambda x, y: F.struct(x["i"].alias("i"), (F.coalesce(x["same"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False))).alias("same")),
    )
    starts = F.array_sort(F.transform(F.filter(both, lambda x: x["same"] & x["i"].isNotNull()), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("words")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["words"] + i + WINDOW - F.greatest(acc["end"], i)).alias("words")
        ),
        lambda acc: acc["words"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def with_measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add the measures; null texts have no word and no line.

    Columns of ``docs`` with the names of measures are overwritten.
    """
    word_list, line_list, window_list = (spare(n, docs.columns) for n in ("_words", "_lines", "_windows"))
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    cut = docs.withColumns(
        {
            word_list: F.filter(F.split(text, SPACES + "+"), lambda w: w != ""),
            line_list: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        }
    )
    words = F.col(word_list)
    count = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
    )
    counted = cut.withColumns(
        {
            "n_words": count.cast("long"),
            "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size(line_list).cast("long"),
            "n_dup_lines": (F.size(line_list) - F.size(F.array_distinct(line_list))).cast("long"),
            window_list: F.when(count >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # A filter on the verdict would otherwise be moved below the projections, with all of them
    # written out in it; it stays above a column that depends on the row's place.
    repeated = F.when(F.monotonically_increasing_id() >= 0, _repeat_words(words, F.col(window_list)))
    return counted.withColumn("n_repeat_words", repeated.cast("long")).drop(word_list, line_list, window_list)


def compiled(rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """One boolean column: no rule is broken. A ratio over nothing breaks none.

    ``lang`` is the language of the text; rules of certain languages spare texts of any other and of none.
    """
    held = F.lit(True)
    for rule in rules:
        value = F.expr(f"try_divide({rule.measure.replace(' / ', ', ')})")
        holds = F.lit(True)
        if rule.least is not None:
            holds = holds & (F.coalesce(value, F.lit(rule.least)) >= rule.least)
        if rule.most is not None:
            holds = holds & (F.coalesce(value, F.lit(rule.most)) <= rule.most)
        if rule.languages is not None:
            judged = F.lit(False) if lang is None else F.coalesce(F.lower(lang).isin(*rule.languages), F.lit(False))
            holds = ~judged | holds
        held = held & holds
    return held


def verdicts(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, lang_column: str = "lang") -> DataFrame:
    """Rows of ``docs`` with the measures, base_failed and kept.

    A text of under 20 words, or with over 30 % of its words in repeated windows, fails
    the base; such a text is never kept, whatever the rules say. Null and empty texts
    fail it. Stop words are asked for in texts of LANGUAGES; a text of another or of no
    language, or a table without that column, is judged by the other rules alone. Repeated
    rows are judged each; an empty table gives an empty one; other columns stay, those named
    as a measure or verdict are overwritten.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lang = F.col(lang_column).cast("string") if lang_column in docs.columns else None
    return with_measures(docs, text_column).withColumns({"base_failed": failed, "kept": ~failed & compiled(rules, lang)})


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, over the table ``documents``."""
    held = []
    for rule in rules:
        top, bottom = rule.measure.split(" / ")
        ratio = f"({top} / nullif({bottom}, 0)::double)"
        listed = ", ".join(f"'{code}'" for code in rule.languages or ())
        spared = f"coalesce(lower(lang) not in ({listed}), true) or " if listed else ""
        if rule.least is not None:
            held.append(f"({spared}coalesce({ratio} >= {rule.least}, true))")
        if rule.most is not None:
            held.append(f"({spared}coalesce({ratio} <= {rule.most}, true))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    with cut as (
      select doc_id, lang, coalesce(text, '') as t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
      from documents),
    windows as (
      select doc_id, i, list_slice(words, i, i + {WINDOW - 1}) as w
      from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from cut)),
    repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
    covered as (
      select doc_id, count(distinct p) as n_repeat_words
      from (select doc_id, unnest(range(i, i + {WINDOW})) as p from repeated) group by doc_id),
    counted as (
      select doc_id, lang, len(words)::bigint as n_words,
        coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}'))::bigint as n_symbols,
        len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        len(list_filter(words, lambda w: lower(w) in ({stop})))::bigint as n_stop_words,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from cut left join covered using (doc_id)),
    based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
      not base_failed and {' and '.join(held)} as kept
    from based"""
