"""Column expressions over nested device-registry records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.text import valid_device_number

# Signs of pure hardware and of a reagent in the classification texts.
INSTRUMENT_WORDS = [
    "system", "instrument", "analyzer", "analyser",
    "amplification", "thermal cycler", "sequencer", "reader",
]
REAGENT_WORDS = ["antibody", "antibodies", "antigen", "reagent", "elisa", "immunoassay"]


def classification_text(product_codes: Column, gmdn_terms: Column) -> Column:
    """All classification texts of a record, joined and in lower case."""
    def both(first: Column, second: Column) -> Column:
        return F.array(F.coalesce(first, F.lit("")), F.coalesce(second, F.lit("")))

    none = F.array().cast("array<string>")
    codes = F.flatten(F.transform(product_codes, lambda p: both(p["name"], p["openfda"]["device_name"])))
    terms = F.flatten(F.transform(gmdn_terms, lambda g: both(g["name"], g["definition"])))
    return F.lower(F.array_join(F.concat(F.coalesce(codes, none), F.coalesce(terms, none)), " "))


def is_bare_instrument(product_codes: Column, gmdn_terms: Column) -> Column:
    """Hardware words and no reagent word in the classification (substring test)."""
    text = classification_text(product_codes, gmdn_terms)
    return text.rlike("|".join(INSTRUMENT_WORDS)) & ~text.rlike("|".join(REAGENT_WORDS))


def submission_numbers(submissions: Column) -> Column:
    """Well-formed submission numbers of a record, upper-cased; NULL array gives none."""
    numbers = F.transform(submissions, lambda s: F.upper(s["submission_number"]))
    return F.coalesce(
        F.array_distinct(F.filter(numbers, valid_device_number)), F.array().cast("array<string>")
    )
