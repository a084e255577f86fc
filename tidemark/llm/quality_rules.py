"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much of its text is rejected."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, map_texts

_WORD = re.compile(WORD)
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words that end in two or more of these marks are junk.
_MARKED = re.compile(r"[#*$%&!]{2}(?=[\x20\x09-\x0D]|$)")
#: Texts of boilerplate lines, in lower case: English, German, French, Spanish.
BOILERPLATE = "|".join(
    [
        r"all rights reserved|licensed under|released under the|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|enable javascript|sign in to|log in to|subscribe to our|click here|share this",
        r"alle rechte vorbehalten|datenschutzerklärung|allgemeine geschäftsbedingungen|cookies (?:akzeptieren|zulassen)|newsletter abonnieren|hier klicken|jetzt anmelden",
        r"tous droits réservés|politique de confidentialité|conditions (?:générales )?d.utilisation|accepter (?:tous )?les cookies|cliquez ici|abonnez-vous à",
        r"todos los derechos reservados|política de privacidad|términos (?:y condiciones )?de uso|aceptar (?:todas )?las cookies|haga clic aquí|suscríbase a",
    ]
)
_BOILERPLATE = re.compile(BOILERPLATE)
#: Of 100 characters in words, how many a document may lose.
MOST_LOST = 50

FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "lost_chars": "bigint", "n_lines_removed": "bigint", "clean_text": "string"}


def line_fails(line: str, words: list[str]) -> bool:
    """Navigation: two bars or more, one for three words at least. Punctuation: a third of the words end in doubled marks, or over 60 words without a mark between sentences. Boilerplate: at most 30 words with a known text."""
    n, bars = len(words), line.count("|")
    if bars >= 2 and 3 * bars >= n:
        return True
    if 3 * len(_MARKED.findall(line)) >= n:
        return True
    if n > 60 and not any(c in line for c in ".!?,;:"):
        return True
    return n <= 30 and _BOILERPLATE.search(line.lower()) is not None


def repeated_words(words: list[str]) -> int:
    """Words inside 5-word windows that the text has twice or more."""
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(grams)) == len(grams):
        return 0
    seen, n, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            n += i + 5 - max(i, end)
            end = i + 5
    return n


def judge(text: str | None) -> tuple:
    """The FIELDS of one text."""
    text = text or ""
    n_words = chars = dups = lost = removed = 0
    words: list[str] = []
    earlier, stay = set(), []
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            size = sum(map(len, own))
            chars += size
            words += own
            if line in earlier:
                dups += 1
            earlier.add(line)
            if line_fails(line, own):
                lost += size
                removed += 1
                continue
        stay.append(line)
    n_words, repeats = len(words), repeated_words(words)
    failed = n_words < 10 or 100 * repeats > 20 * n_words
    return n_words, chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, not failed and 100 * lost <= MOST_LOST * chars, lost, removed, "\n".join(stay)


def _judge_all(texts: list[str | None]) -> list[list]:
    return [list(c) for c in zip(*map(judge, texts))]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts, base_failed, kept, and the cleaned text.

    A null text counts as empty: no words, base_failed. Repeated rows and null ids are judged like any other row; an
    empty table gives no rows. Columns other than the two named ones are neither read nor returned.
    """
    return map_texts(docs, [id_col], text_col, FIELDS, _judge_all)


def clean(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, with their failing lines removed; all columns stay, and n_chars, if there, follows the text.

    Null and empty texts go, as they have no words; null ids and rows that repeat stay or go by their texts; an empty table stays empty.
    """
    kept, text = list(FIELDS).index("kept"), docs.columns
    out = map_texts(docs, text, text_col, FIELDS, _judge_all, drop=lambda got: got[kept], replace="clean_text")
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col in docs.columns else out


#: The digest in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d),
w AS (SELECT r, k, line, regexp_extract_all(line, '{WORD}') AS ws FROM l),
j AS (
  SELECT r, k, line, ws, len(ws) AS n, length(array_to_string(ws, '')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth,
    length(line) - length(replace(line, '|', '')) AS bars, len(regexp_extract_all(line || chr(10), '[#*$%&!]{{2}}[\x20\x09-\x0D]')) AS marked
  FROM w WHERE len(ws) > 0),
f AS (SELECT *, (bars >= 2 AND 3 * bars >= n) OR 3 * marked >= n OR (n > 60 AND NOT regexp_matches(line, '[.!?,;:]')) OR (n <= 30 AND regexp_matches(lower(line), '{BOILERPLATE}')) AS fails FROM j),
a AS (SELECT r, sum(n) AS n_words, sum(chars) AS word_chars, count(*) FILTER (nth > 1) AS dups, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM f GROUP BY r),
e AS (SELECT r, k, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM j),
o AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k, i) AS p, word FROM e),
g AS (SELECT r, p, word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS gram FROM o WINDOW t AS (PARTITION BY r ORDER BY p)),
h AS (SELECT r, p, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
c AS (SELECT r, p, max(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM h),
s AS (SELECT r, count(*) FILTER (covered) AS repeats FROM c GROUP BY r),
x AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN a USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= {MOST_LOST} * word_chars AS kept
FROM x"""
