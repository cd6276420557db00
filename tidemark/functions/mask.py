"""Salted pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token(x: Column, kind: str, salt: str) -> Column:
    """kind_ and 16 hex digits of the SHA-256 of kind, salt and text. Empty texts and nulls stay; so do tokens of that kind."""
    made = F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(F.lit(kind + salt), x), 256), 1, 16))
    return F.when((x == "") | x.rlike(f"^{kind}_[0-9a-f]{{16}}$"), x).otherwise(made)


def mask(df: DataFrame, columns: dict[str, str], salt: str) -> DataFrame:
    """df with each column (given its kind) as tokens."""
    return df.withColumns({x: token(F.col(x).cast("string"), kind, salt) for x, kind in columns.items()})
