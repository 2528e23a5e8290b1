"""Record strings: COL attribute VAL value ..., their parsing, prompts, and decisions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a record string is read. White space and words are Unicode's.
_KV = r"(?isU)COL\s+(\S+)\s+VAL\s+(.*?)(?=\s+COL\s+\S+\s+VAL\s+|$)"

# The prompts' wording, which the answers of a model depend on.
PROMPT = (
    "You are an entity matching system.\n"
    "Question: Do the two entity descriptions refer to the same real-world entity?\n"
    "Answer with 'Yes' if they do and 'No' if they do not.\n\n"
    "Entity A:\n%s\n\nEntity B:\n%s"
)
JELLYFISH_PROMPT = (
    "You are tasked with determining whether two records listed below are the same based on the information provided.\n"
    "Carefully compare the {attribute 1}, {attribute 2}... for each record before making your decision.\n"
    "Note: Missing values (N/A or \"nan\") should not be used as a basis for your decision.\n"
    "Record A: [%s]\n"
    "Record B: [%s]\n"
    "Are record A and record B the same entity? Choose your answer from: [Yes, No]."
)
SYSTEM = "You are an entity matching system."


def serialize(*attrs: tuple[str, Column]) -> Column:
    """Attributes in order, each followed by a space; null values are empty."""
    return F.concat(*[F.concat(F.lit(f"COL {a} VAL "), F.coalesce(v.cast("string"), F.lit("")), F.lit(" ")) for a, v in attrs])


def clean_value(v: Column) -> Column:
    """Without language tags and one pair of quotes; white space single; none and nan are N/A."""
    v = F.trim(F.regexp_replace(F.trim(v), r"(?iU)@[a-z]{2,3}\b", ""))
    v = F.regexp_replace(v, r'(?s)^"(.*)"$', "$1")
    v = F.when(v.rlike(r'^"[^"]*"'), F.regexp_extract(v, r'^"([^"]*)"', 1)).otherwise(v)
    v = F.trim(F.regexp_replace(v, r"(?U)\s+", " "))
    return F.when(F.lower(v).isin("none", "nan"), "N/A").otherwise(v)


def parse(record: Column) -> Column:
    """array<struct<attr, val>> in order; attributes in lower case, _ as space."""
    attrs = F.regexp_extract_all(record, F.lit(_KV), 1)
    values = F.regexp_extract_all(record, F.lit(_KV), 2)
    both = F.arrays_zip(attrs.alias("a"), values.alias("v"))
    return F.transform(both, lambda p: F.struct(F.lower(F.replace(p["a"], F.lit("_"), F.lit(" "))).alias("attr"), clean_value(p["v"]).alias("val")))


def flatten(record: Column, lines: bool = False) -> Column:
    """attr: val, joined; a record that doesn't parse as it is, trimmed."""
    shown = F.transform(parse(record), lambda p: F.concat(F.lit("- " if lines else ""), p["attr"], F.lit(": "), p["val"]))
    out = F.array_join(shown, "\n" if lines else ", ")
    return F.when(out == "", F.trim(record)).otherwise(out)


def prompt(left: Column, right: Column, model: str = "") -> Column:
    """The template goes by the model's name: one kind of model gets flattened records, the others the records as they are. Braces stay."""
    if "jellyfish" in model.lower():
        return F.format_string(JELLYFISH_PROMPT, flatten(left), flatten(right))
    return F.format_string(PROMPT, left, right)


def chat(left: Column, right: Column, model: str = "") -> Column:
    """The prompt as messages of a chat: array<struct<role, content>>."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit(SYSTEM)), said("user", prompt(left, right, model)))


def arity(line: Column) -> Column:
    """The number of tab-separated fields: lenient readers take more than 2, strict ones exactly 3."""
    return F.size(F.split(line, "\t", -1))


def yes_label(answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).rlike(r"(?U)^\s*yes\b"), F.lit(False)).cast("int")


def title(record: Column) -> Column:
    r"""The quoted, language-tagged title; an error if there is none."""
    pattern = r'COL title VAL  "(.*?)"@\w+'
    return F.when(record.rlike(pattern), F.regexp_extract(record, pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("no title in "), record)))


def normal_number(token: Column) -> Column:
    """Whole numbers without decimals, others with two; what is no number, or is 2**63 or more, stays."""
    x = token.try_cast("double")
    plain = token.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$") & (F.abs(x) < 2.0**63)
    whole = F.format_string("%d", F.when(F.abs(x) < 2.0**63, x).cast("long"))
    return F.when(plain & (x == F.round(x)), whole).when(plain, F.format_string("%.2f", x)).otherwise(token)


def tag_token(token: Column) -> Column:
    """Numbers in normal form; longer tokens with a digit are marked as identifiers."""
    number = token.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    ident = (F.length(token) >= 7) & token.rlike(r"\d")
    return F.when(number, normal_number(token)).when(ident, F.concat(F.lit("ID "), token)).otherwise(token)


def positive_chance(l0: Column, l1: Column) -> Column:
    """Softmax of two logits, the second one's share."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))


def decide(p: Column, threshold=0.5) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(0.5 if threshold is None else threshold)
    return (p > t).cast("int")


def confidence(p: Column, match: Column, late_fusion: bool = False) -> Column:
    """The chance of the class that was decided; late fusion shows the cosine itself."""
    return p if late_fusion else F.when(match == 1, p).otherwise(1 - p)
