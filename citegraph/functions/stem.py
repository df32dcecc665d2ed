"""Porter's published 1980 suffix stripping as column expressions.

A word passes through one expression per step of the paper, inside the JVM, and
callers apply it to the distinct vocabulary only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letter classes of the paper ("y" after a consonant is a vowel).
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
MEASURE_POSITIVE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
MEASURE_ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
MEASURE_ABOVE_ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLE_END = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy") + ")$"

# Suffixes of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _cut(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.lit(len(suffix)))


def _longest_first(suffixes):
    return sorted(suffixes, key=len, reverse=True)


def _first_match(word: Column, rules) -> Column:
    """The first rule whose suffix fits decides, whether or not it changes the word."""
    chain = None
    for suffix, outcome in rules:
        test = word.endswith(suffix)
        chain = F.when(test, outcome) if chain is None else chain.when(test, outcome)
    return chain.otherwise(word)


def _suffix_map(word: Column, table: dict[str, str], condition: str) -> Column:
    rules = []
    for suffix in _longest_first(table):
        stem = _cut(word, suffix)
        new = F.concat(stem, F.lit(table[suffix]))
        rules.append((suffix, F.when(stem.rlike(condition), new).otherwise(word)))
    return _first_match(word, rules)


def _step_1a(w: Column) -> Column:
    return _first_match(w, [
        ("sses", _cut(w, "es")), ("ies", _cut(w, "es")), ("ss", w), ("s", _cut(w, "s")),
    ])


def _tidy(stem: Column) -> Column:
    return (
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE_END), _cut(stem, "x"))
        .when(stem.rlike(SHORT_END), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _step_1b(w: Column) -> Column:
    agreed = _cut(w, "eed")
    return _first_match(w, [
        ("eed", F.when(agreed.rlike(MEASURE_POSITIVE), F.concat(agreed, F.lit("ee"))).otherwise(w)),
        ("ed", F.when(_cut(w, "ed").rlike(HAS_VOWEL), _tidy(_cut(w, "ed"))).otherwise(w)),
        ("ing", F.when(_cut(w, "ing").rlike(HAS_VOWEL), _tidy(_cut(w, "ing"))).otherwise(w)),
    ])


def _step_1c(w: Column) -> Column:
    stem = _cut(w, "y")
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _step_4(w: Column) -> Column:
    rules = []
    for suffix in _longest_first(STEP_4):
        stem = _cut(w, suffix)
        fits = stem.rlike(MEASURE_ABOVE_ONE)
        if suffix == "ion":
            fits = fits & stem.rlike("[st]$")
        rules.append((suffix, F.when(fits, stem).otherwise(w)))
    return _first_match(w, rules)


def _step_5a(w: Column) -> Column:
    stem = _cut(w, "e")
    keep = stem.rlike(MEASURE_ONE) & stem.rlike(SHORT_END)
    drop = stem.rlike(MEASURE_ABOVE_ONE) | (stem.rlike(MEASURE_ONE) & ~keep)
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _step_5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_ABOVE_ONE), _cut(w, "l")).otherwise(w)


def _let(value: Column, step) -> Column:
    """Apply a step to a value that is computed once, however often the step uses it."""
    return F.transform(F.array(value), step)[0]


def stem(word: str | Column) -> Column:
    """The stem of a word; words of one or two letters stay as they are."""
    col = F.col(word) if isinstance(word, str) else word
    steps = [
        _step_1a, _step_1b, _step_1c,
        lambda w: _suffix_map(w, STEP_2, MEASURE_POSITIVE),
        lambda w: _suffix_map(w, STEP_3, MEASURE_POSITIVE),
        _step_4, _step_5a, _step_5b,
    ]
    # A leading y is a consonant; upper case keeps the letter classes simple.
    value = F.regexp_replace(F.lower(col), "^y", "Y")
    for step in steps:
        value = _let(value, step)
    return F.when(F.length(col) > 2, F.lower(value)).otherwise(F.lower(col))


def stem_vocabulary(vocabulary: DataFrame, word: str = "word", out: str = "stemmed") -> DataFrame:
    """Add the stem of every word of a vocabulary."""
    return vocabulary.withColumn(out, stem(word))
