"""The one string similarity that has no native counterpart."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ligature.functions.text import letters_and_digits, local_part


@F.pandas_udf(DoubleType())
def gestalt(name: pd.Series, tokens: pd.Series, local: pd.Series) -> pd.Series:
    """Largest Ratcliff-Obershelp ratio of the name and of each of its words with the local part, times 100."""

    def one(n: str, words: list[str], x: str) -> float:
        if not n or not x:
            return 0.0
        return max(SequenceMatcher(None, t, x).ratio() for t in [n, *words] if t) * 100

    return pd.Series([one(n, w, x) for n, w, x in zip(name, tokens, local)])


def email_similarity(rows: DataFrame, name_col: str, email_col: str, out: str = "name_email_sim") -> DataFrame:
    """``rows`` with the similarity of name and e-mail; 0 if either is blank. Each distinct pair is compared once."""
    pairs = rows.select(F.coalesce(F.col(name_col), F.lit("")).alias("_n"), F.coalesce(F.col(email_col), F.lit("")).alias("_e")).distinct()
    words = F.filter(F.transform(F.split("_n", r"(?U)\s+"), letters_and_digits), lambda t: t != "")
    scored = pairs.select("_n", "_e", gestalt(letters_and_digits(F.col("_n")), words, letters_and_digits(local_part(F.col("_e")))).alias(out))
    return rows.join(scored, (F.coalesce(F.col(name_col), F.lit("")) == F.col("_n")) & (F.coalesce(F.col(email_col), F.lit("")) == F.col("_e")), "left").drop("_n", "_e")
