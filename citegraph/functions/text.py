"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegraph import fixed_values as fixed


def quoted(word: str) -> str:
    """The word as a pattern that matches only itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_word(column: str | Column, *words: str) -> Column:
    """Whole-word, case-insensitive match of any word; letters of any script are letters."""
    col = F.col(column) if isinstance(column, str) else column
    edge = r"[^\p{L}\p{N}_]"
    return col.rlike(rf"(?i)(^|{edge})({'|'.join(map(quoted, words))})($|{edge})")


def contains_any(columns, words) -> Column:
    """OR over every column and word: one pattern per column, for a single scan."""
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(contains_word(column, *words), F.lit(False))
    return found


def strip_before_filter(column: str | Column) -> Column:
    """Cleaning up to the point where unusable texts are dropped."""
    text = F.col(column) if isinstance(column, str) else column
    text = F.regexp_replace(text, fixed.COPYRIGHT_TAIL, " ")
    text = F.lower(text)
    text = F.regexp_replace(text, fixed.URL_TAIL, "")
    text = F.regexp_replace(text, fixed.NON_ASCII, "")
    text = F.regexp_replace(text, fixed.DIGITS, "")
    return F.replace(text, F.lit("/"), F.lit(" "))


def strip_punctuation(text: Column, replacements=fixed.WORD_REPLACEMENTS) -> Column:
    """Delete punctuation without a gap, then replace whole words."""
    text = F.regexp_replace(text, fixed.PUNCTUATION, "")
    for word, replacement in replacements:
        plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, rf"\b{quoted(word)}\b", plain)
    return text


def words(column: str | Column) -> Column:
    """Array of lower-case words in order of appearance."""
    col = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(col), F.lit(fixed.WORD_PATTERN), F.lit(0))


def replace_first(column: str | Column, literal: str, replacement: str) -> Column:
    """Replace only the first occurrence of a plain text."""
    col = F.col(column) if isinstance(column, str) else column
    at = F.instr(col, literal)
    tail = F.substring(col, at + F.lit(len(literal)), F.length(col))
    head = F.substring(col, F.lit(1), at - F.lit(1))
    return F.when(at > 0, F.concat(head, F.lit(replacement), tail)).otherwise(col)
