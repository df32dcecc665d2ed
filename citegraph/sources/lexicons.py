"""Stop-word tables ``(word, lexicon)``."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession

from citegraph import fixed_values as fixed

_SCHEMA = "word STRING, lexicon STRING"

#: The lists used by the registered queries.
STOP_LANGUAGES = ("english", "french")


def shipped_words(language: str) -> list[str]:
    """A list that Spark ships, read from its library without a session."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in sorted(glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))):
        with zipfile.ZipFile(jar) as library:
            text = library.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt")
        return [word for word in text.decode().splitlines() if word]
    raise FileNotFoundError(f"no spark-mllib library under {home}")


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


#: The same lists as SQL.
STOP_SQL = _sql_list([w for language in STOP_LANGUAGES for w in shipped_words(language)]
                     + list(fixed.EXTRA_STOP_WORDS))


def stop_words(spark: SparkSession, languages=("english",), extra=fixed.EXTRA_STOP_WORDS,
               lexicon: DataFrame | None = None) -> DataFrame:
    """The lists Spark ships, rows of your own, and optionally a whole lexicon table."""
    rows = [
        (word, language)
        for language in languages
        for word in StopWordsRemover.loadDefaultStopWords(language)
    ]
    rows += [(word, "custom") for word in extra]
    table = spark.createDataFrame(rows, _SCHEMA)
    return table if lexicon is None else table.unionByName(lexicon.select("word", "lexicon"))
