"""Column expressions over search terms and free text. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace plus the information separators, which Java's \s leaves out.
WS = r"[\s\x1C-\x1F]"

# Greek letters and their spelled-out Latin names.
GREEK_LETTERS = {
    "α": "alpha", "Α": "Alpha",
    "β": "beta", "Β": "Beta",
    "γ": "gamma", "Γ": "Gamma",
    "δ": "delta", "Δ": "Delta",
    "κ": "kappa", "Κ": "Kappa",
    "λ": "lambda", "Λ": "Lambda",
    "μ": "mu", "Μ": "Mu",
}

# Words that show a record is about an antibody.
ANTI_WORDS = ["anti", "antibody", "antibodies", "autoantibody", "autoantibodies", "ab"]
ANTIBODY_WORDS = ["antibody", "antibodies", "autoantibody", "autoantibodies"]

# Words without search value inside an expansion phrase.
EXPANSION_STOPWORDS = ["anti", "antibody"]

EXPLICIT, IMPLIED, NONE = "explicit", "implied", "none"

_ISOTYPE = r"(?iU)\s+Ig[AGME][1-4]?$"


def strip_ws(c: Column) -> Column:
    """Trim any Unicode whitespace at both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def flatten_ws(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def padded(c: Column) -> Column:
    """Normal form ``' tok tok '``: lower case, one space between word tokens.

    A phrase occurs in a text exactly when the padded phrase is a substring of the
    padded text. Text without a word character becomes a single space; NULL stays NULL.
    """
    return F.regexp_replace(
        F.concat(F.lit(" "), F.lower(c), F.lit(" ")), r"[^\p{L}\p{N}]+", " "
    )


def padded_values(c: Column) -> Column:
    """Normal form of a multi-valued field; ``|`` keeps phrases inside one value."""
    return F.concat_ws("|", F.transform(c, padded))


def words_of(padded_text: Column) -> Column:
    """Word tokens of a padded text, in order, with repeats."""
    return F.array_remove(F.array_remove(F.split(padded_text, " "), ""), "|")


def contains_phrase(padded_text: Column, padded_phrase: Column) -> Column:
    """Phrase test; the empty phrase (a single space) never matches."""
    return F.coalesce(
        (padded_phrase != F.lit(" ")) & F.contains(padded_text, padded_phrase), F.lit(False)
    )


def greek_to_latin(c: Column) -> Column:
    for letter, name in GREEK_LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c


def strip_anti_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)^anti[-\s]+", "")


def has_anti_prefix(c: Column) -> Column:
    return strip_ws(c).rlike(r"(?iU)^anti[-\s]")


def strip_isotype(c: Column) -> Column:
    return F.regexp_replace(c, _ISOTYPE, "")


def has_isotype(c: Column) -> Column:
    return c.rlike(_ISOTYPE)


def anti_requirement_mode(c: Column) -> Column:
    return (
        F.when(has_anti_prefix(c), F.lit(EXPLICIT))
        .when(has_isotype(c), F.lit(IMPLIED))
        .otherwise(F.lit(NONE))
    )


def split_tokens(c: Column) -> Column:
    """Split on whitespace and slashes; hyphens stay inside a token."""
    return F.array_remove(F.split(c, rf"(?U)[\s\x1C-\x1F/]+"), "")


def antigen_of(c: Column) -> Column:
    """The bare antigen: no isotype suffix, no anti prefix."""
    return strip_ws(strip_anti_prefix(strip_isotype(c)))


def fused_anti(c: Column) -> Column:
    """``Anti`` and a one-token antigen run together; NULL where that makes no word."""
    tokens = split_tokens(antigen_of(c))
    word = F.concat(F.lit("Anti"), F.regexp_replace(F.try_element_at(tokens, F.lit(1)), "[^A-Za-z0-9]", ""))
    usable = (anti_requirement_mode(c) != NONE) & (F.size(tokens) == 1) & (word != "Anti")
    return F.when(usable, word)


def orthographic_variants(antigen: Column) -> Column:
    """Other spellings: camel case split, hyphens opened, spaces hyphenated, all fused."""
    camel = F.regexp_replace(antigen, "([a-z])([A-Z])", "$1 $2")
    opened = F.replace(antigen, F.lit("-"), F.lit(" "))
    hyphenated = F.when(
        F.contains(antigen, F.lit(" ")), F.regexp_replace(antigen, rf"(?U){WS}+", "-")
    ).otherwise(antigen)
    fused = F.regexp_replace(antigen, rf"(?U)[\s\x1C-\x1F-]+", "")
    return F.array_except(F.array(camel, opened, hyphenated, fused), F.array(antigen))


def expansion_key(c: Column) -> Column:
    """Store key of a term. Greek letters are kept, so ``β2`` and ``beta2`` differ."""
    return F.lower(antigen_of(c))


def split_expansion_tokens(c: Column) -> Column:
    return F.filter(
        F.split(c, r"(?U)[\s\x1C-\x1F/,()]+"),
        lambda t: (t != "") & ~F.lower(t).isin(*EXPANSION_STOPWORDS),
    )


def group_implies_anti(tokens: Column) -> Column:
    """A synonym that is a single ``anti...`` word carries the antibody sense itself."""
    return (F.size(tokens) == 1) & F.coalesce(
        F.try_element_at(tokens, F.lit(1)).rlike("(?i)^anti"), F.lit(False)
    )


def expansion_phrase(full: Column, search: Column) -> Column:
    """The ``/``-joined synonym list, or the full name where there is none."""
    return F.coalesce(F.when(search != "", search), F.when(full != "", full))


def expansion_groups(phrase: Column) -> Column:
    """Synonym groups for text matching: stop words dropped, empty groups dropped."""
    return F.filter(
        F.transform(F.split(phrase, "/"), split_expansion_tokens), lambda g: F.size(g) > 0
    )


def registry_token_groups(phrase: Column) -> Column:
    """Synonym groups for the registry: stop words kept, repeats (any case) dropped.

    The first spelling of a repeated group is the one kept.
    """
    groups = F.filter(F.transform(F.split(phrase, "/"), split_tokens), lambda g: F.size(g) > 0)

    def label(g: Column) -> Column:
        return F.lower(F.array_join(g, "|"))

    labels = F.transform(groups, label)
    return F.filter(groups, lambda g, i: F.array_position(labels, label(g)) == i + 1)


def contains_any_word(text: Column, term: Column) -> Column:
    """True when any word of the term is a word of the text."""
    return F.coalesce(F.arrays_overlap(words_of(padded(text)), words_of(padded(term))), F.lit(False))


def join_names(c: Column) -> Column:
    """Display form of a field stored as a JSON string or a JSON list of strings."""
    return F.concat_ws("; ", name_values(c))


def name_values(c: Column) -> Column:
    """Array form of a field holding either plain text or a JSON list of strings."""
    listed = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>"))
    return F.when(c.isNotNull(), F.coalesce(listed, F.array(c)))


def parse_date(c: Column) -> Column:
    """Date of a text field; malformed text gives NULL."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def pack_record(*cols) -> Column:
    """The whole record as one JSON text."""
    return F.to_json(F.struct(*cols))


def relabel_mode(mode: Column, source: Column) -> Column:
    """Name of the expansion tier by the resolver that supplied the expansion."""
    return (
        F.when((mode == "expansion") & (source == "local-llm"), F.lit("ai-suggested"))
        .when((mode == "expansion") & (source == "umls"), F.lit("umls"))
        .otherwise(mode)
    )


def valid_device_number(c: Column) -> Column:
    """True for a well-formed clearance or de-novo number."""
    return F.coalesce(c.rlike(r"^(K\d{6}|DEN\d{6})$"), F.lit(False))
