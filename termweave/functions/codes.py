"""Column expressions over hierarchical codes (H-01..H-04, IX-01) and their table job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical URL of the code system and the shape of its codes.
ICD10CM_URL = "http://hl7.org/fhir/sid/icd-10-cm"
CODE_SHAPE = r"^[A-Za-z][0-9][0-9A-Za-z](\.?[0-9A-Za-z]{0,4})?$"
CATEGORY_LENGTH = 3
EXTENDED_LENGTH = 7


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def undotted(c: Column) -> Column:
    return F.upper(strip(F.replace(c, F.lit("."), F.lit(""))))


def dotted(compact: Column) -> Column:
    """Place the dot of an already undotted code."""
    head = F.substring(compact, 1, CATEGORY_LENGTH)
    tail = F.substring(compact, CATEGORY_LENGTH + 1, 2**31 - 1)
    return F.when(F.length(compact) <= CATEGORY_LENGTH, compact).otherwise(F.concat(head, F.lit("."), tail))


def to_dotted(c: Column) -> Column:
    return dotted(undotted(c))


def is_code_like(c: Column) -> Column:
    return strip(c).rlike(CODE_SHAPE)


def code_prefix(c: Column) -> Column:
    """`S72.9-` -> `S72.9`, `A30.-` -> `A30`."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"-+$", ""), r"\.+$", "")


def variant_stem(c: Column) -> Column:
    """A code of seven significant characters without its last one; any other code unchanged."""
    extended = F.length(F.replace(c, F.lit("."), F.lit(""))) == EXTENDED_LENGTH
    return F.when(extended, F.substring(c, 1, F.length(c) - 1)).otherwise(c)


def code_prefixes(c: Column, proper: bool = False) -> Column:
    """Dotted prefixes of a dotted code, from the category to the code itself."""
    compact = F.replace(c, F.lit("."), F.lit(""))
    last = F.length(compact) - (1 if proper else 0)
    return F.when(
        last >= CATEGORY_LENGTH,
        F.transform(
            F.sequence(F.lit(CATEGORY_LENGTH), last),
            lambda n: dotted(F.substring(compact, F.lit(1), n)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def norm_text(c: Column) -> Column:
    """Lower case, commas as blanks, single blanks, no blanks at the ends."""
    return strip(F.regexp_replace(F.translate(F.lower(c), ",", " "), r"\s+", " "))


def normalise_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds the dotted form, the code-like flag, the category prefix and the variant stem."""
    c = F.col(code)
    return (
        df.withColumn("dotted", to_dotted(c))
        .withColumn("code_like", is_code_like(c))
        .withColumn("prefix", code_prefix(c))
        .withColumn("stem", variant_stem(F.col("dotted")))
    )
