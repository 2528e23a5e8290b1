"""Domain-knowledge tagging: entity start markers, numbers in normal form, identifiers.

The recogniser is a callable from a token list to (start token, label) pairs and runs in Arrow batches; end markers are
never written. What a marker says depends on the kind: product text has PRODUCT and NUM, general text the label itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.records import tag_token

# The labels that each kind marks.
PRODUCT_LABELS = ("NORP", "GPE", "LOC", "PERSON", "PRODUCT")
NUMBER_LABELS = ("DATE", "QUANTITY", "TIME", "PERCENT", "MONEY")
GENERAL_LABELS = ("PERSON", "ORG", "LOC", "PRODUCT", "DATE", "QUANTITY", "TIME")

#: Tokens of a record's structure, by what they are labelled.
STRUCTURE = {"HD": ("COL", "VAL"), "<SEP>": ("[CLS]", "[SEP]")}

Recogniser = Callable[[list[str]], list[tuple[int, str]]]


def word_list(labels: dict[str, str]) -> Recogniser:
    """A recogniser that marks listed words; stands in where no model is at hand."""
    return lambda tokens: [(i, labels[t]) for i, t in enumerate(tokens) if t in labels]


def token_labels(text: Column) -> Column:
    """HD, <SEP> or O for each token of a text split at single spaces."""
    kind = lambda t: F.when(t.isin(*STRUCTURE["HD"]), "HD").when(t.isin(*STRUCTURE["<SEP>"]), "<SEP>").otherwise("O")
    return F.transform(F.split(text, " ", -1), kind)


def _marker(label: str, kind: str) -> str | None:
    if kind == "product":
        return "PRODUCT" if label in PRODUCT_LABELS else "NUM" if label in NUMBER_LABELS else None
    return label if label in GENERAL_LABELS else None


def tag(df: DataFrame, recogniser: Recogniser, kind: str = "product", text: str = "text") -> DataFrame:
    """df with column tagged. The recogniser gives a marker or null per token; all else are built-ins."""

    @F.pandas_udf("array<string>")
    def markers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            out = []
            for tokens in rows:
                own: list[str | None] = [None] * len(tokens)
                for i, label in recogniser(list(tokens)):
                    own[i] = _marker(label, kind) or own[i]
                out.append(own)
            yield pd.Series(out)

    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    marked = df.withColumn("_tokens", tokens).withColumn("_marks", markers("_tokens"))
    shown = F.zip_with("_tokens", "_marks", lambda t, m: F.concat(F.coalesce(F.concat(m, F.lit(" ")), F.lit("")), tag_token(t)))
    return marked.withColumn("tagged", F.array_join(shown, " ")).drop("_tokens", "_marks")
