"""Mining decision-summary documents: measurand, predicate citations, addresses.

All extraction is row-local: each document is parsed inside the task that read it, with
built-in regular expressions and array functions over its lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.text import flatten_ws, strip_ws, valid_device_number

# Document archive addresses.
REVIEW_BASE = "https://www.accessdata.fda.gov/cdrh_docs/reviews"
SUMMARY_BASE = "https://www.accessdata.fda.gov/cdrh_docs"

# Section labels in order of preference, and the shape of a section.
MEASURAND_LABELS = [
    r"Measurand",
    r"Analyte",
    r"Type of Test(?:s)?(?:\s+or\s+Tests\s+Performed)?",
    r"Intended Use",
]
LABEL_WORDS = ["Measurand", "Analyte", "Type", "Intended"]
SECTION = r"[A-Z]\.?\s*(<label>)s?\s*:\s*([\s\S]{1,400}?)\s*(?=[A-Z]\.?\s+[A-Z][a-z]|$)"

# Headers, rows and section markers of the four citation templates.
NUMBER = r"K\d{6}|DEN\d{6}"
NEXT_SECTION = r"^([A-Z]\.?|[0-9]+\.)\s+[A-Z]"
TABLE_HEADER = r"(?i)Predicate\s+Device\s+Names?\s+and\s+510"
TABLE_COLUMNS = r"(?i)^Predicate\s+Name\b.*510"
TABLE_ROW = rf"^(.+?)\s+({NUMBER})\s*$"
NAMES_HEADER = r"(?i)Predicate\s+device\s+names?\s*\(?s?\)?\s*:"
NUMBERS_HEADER = r"(?i)Predicate\s+510\(?k\)?\s+numbers?\s*\(?s?\)?\s*:"
NUMBER_ONLY = rf"^({NUMBER})$"
NUMBER_FIRST_ROW = rf"^({NUMBER})\s*-\s*(.+)$"
PAIR_HEADER = r"(?i)Predicate\s+device\s+names?\s*\(Predicate\s+510"
PAIR_ROW = rf"^(.+?)\s*\(({NUMBER})\)\s*$"
ANY_HEADER = r"(?i)Predicate\s+(Device\s+Names?|510)"

CITATION_TYPE = "array<struct<name:string,k_number:string>>"


def _u(pattern: str) -> str:
    """Unicode-aware character classes, as the text is."""
    return pattern.replace("(?i)", "(?iU)") if pattern.startswith("(?i)") else "(?U)" + pattern


# -- addresses and fetch log ------------------------------------------------------------


def document_year_folder(k: Column) -> Column:
    """Archive folder of a number's year: none for 1996-2001, no leading zero after."""
    yy = F.regexp_extract(k, r"^(?:DEN|K)(\d\d)", 1).try_cast("int")
    return F.when((yy >= 96) | (yy <= 1), F.lit("")).otherwise(yy.cast("string"))


def candidate_document_urls(k: Column) -> Column:
    review = F.concat(F.lit(REVIEW_BASE + "/"), k, F.lit(".pdf"))
    summary = F.concat(
        F.lit(SUMMARY_BASE + "/pdf"), document_year_folder(k), F.lit("/"), k, F.lit(".pdf")
    )
    return F.when(valid_device_number(k), F.array(review, summary))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# -- measurand --------------------------------------------------------------------------


def extract_measurand(text: Column) -> Column:
    """Struct(label, value) of the best labelled section, or NULL.

    Case matters: section headers are capitalised, prose mentions are not. Texts without
    any word of a label are passed over before they are flattened.
    """

    def section(flat: Column, label: str) -> Column:
        # The text is searched once per label; label and value are read from the short match.
        pattern = SECTION.replace("<label>", label)
        return _let(
            F.regexp_extract(flat, pattern, 0),
            lambda found: F.when(found != "", F.struct(
                F.regexp_extract(found, pattern, 1).alias("label"),
                F.trim(F.regexp_extract(found, pattern, 2)).alias("value"),
            )),
        )

    worth = reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in LABEL_WORDS])
    found = _let(flatten_ws(text), lambda flat: F.coalesce(*[section(flat, x) for x in MEASURAND_LABELS]))
    return F.when(worth, found)


# -- lines ------------------------------------------------------------------------------


def text_lines(text: Column) -> Column:
    """Trimmed non-blank lines, for every kind of line break."""
    return F.array_remove(F.transform(F.split(text, r"\R|[\x1C-\x1E]"), strip_ws), "")


def _positions(lines: Column, test) -> Column:
    """0-based positions of the lines that pass the test."""
    return F.filter(
        F.transform(lines, lambda ln, i: F.when(test(ln), i)), lambda i: i.isNotNull()
    )


def _first(lines: Column, test) -> Column:
    return F.array_min(_positions(lines, test))


def _after(lines: Column, position: Column) -> Column:
    """Lines following a 0-based position; NULL when there is no such position."""
    return F.slice(lines, position + 2, F.greatest(F.size(lines) - position - 1, F.lit(0)))


def lines_until_next_section(lines: Column, position: Column) -> Column:
    """Lines after ``position`` up to the next section marker.

    The first line after it always belongs to the section, whatever it looks like.
    """

    def section(rest: Column) -> Column:
        marked = _positions(rest, lambda ln: ln.rlike(_u(NEXT_SECTION)))
        end = F.array_min(F.filter(marked, lambda i: i > 0))
        return F.slice(rest, F.lit(1), F.coalesce(end, F.size(rest)))

    return _let(_after(lines, position), section)


def _pairs(rows: Column, pattern: str, name_group: int, number_group: int) -> Column:
    p = _u(pattern)
    read = F.transform(
        rows,
        lambda ln: F.struct(
            strip_ws(F.regexp_extract(ln, p, name_group)).alias("name"),
            F.regexp_extract(ln, p, number_group).alias("k_number"),
        ),
    )
    return F.filter(read, lambda r: r["k_number"] != "")


def _found(citations: Column) -> Column:
    return F.coalesce(citations.cast(CITATION_TYPE), F.array().cast(CITATION_TYPE))


def citation_lines(text: Column) -> Column:
    """Lines of a document that has some citation header; no lines for all others."""
    worth = text.rlike(_u(ANY_HEADER))
    return F.when(worth, text_lines(text)).otherwise(F.array().cast("array<string>"))


def citations_table(lines: Column) -> Column:
    """One combined table: a block of ``name  number`` rows under its header."""

    def is_row(ln: Column) -> Column:
        return ln.rlike(_u(TABLE_ROW))

    def rows_of(block: Column) -> Column:
        end = _first(block, lambda ln: ~is_row(ln))
        return F.slice(block, F.lit(1), F.coalesce(end, F.size(block)))

    body = F.filter(
        _after(lines, _first(lines, lambda ln: ln.rlike(_u(TABLE_HEADER)))),
        lambda ln: ~ln.rlike(_u(TABLE_COLUMNS)),
    )
    # The block runs from the first row line to the first other line that follows a row.
    block = _let(body, lambda b: _after(b, _first(b, is_row) - 1))
    return _found(_pairs(_let(block, rows_of), TABLE_ROW, 1, 2))


def citations_two_lists(lines: Column) -> Column:
    """A list of names and a list of numbers, paired by position."""

    def pair(names: Column, numbers: Column) -> Column:
        n = F.least(F.size(names), F.size(numbers))
        return F.transform(
            F.slice(names, F.lit(1), n),
            lambda name, i: F.struct(name.alias("name"), F.get(numbers, i).alias("k_number")),
        )

    def under(names_at: Column) -> Column:
        # The line that opens the names does not also open the numbers.
        numbers_at = F.array_min(
            F.filter(
                _positions(lines, lambda ln: ln.rlike(_u(NUMBERS_HEADER))), lambda i: i != names_at
            )
        )
        names = F.filter(
            lines_until_next_section(lines, names_at), lambda ln: ~ln.rlike(_u(NUMBERS_HEADER))
        )
        numbers = F.filter(
            lines_until_next_section(lines, numbers_at), lambda ln: ln.rlike(_u(NUMBER_ONLY))
        )
        return _let(names, lambda a: _let(numbers, lambda b: pair(a, b)))

    return _found(_let(_first(lines, lambda ln: ln.rlike(_u(NAMES_HEADER))), under))


def citations_number_first(lines: Column) -> Column:
    """Lines ``number - name`` under a numbers header."""
    rows = lines_until_next_section(lines, _first(lines, lambda ln: ln.rlike(_u(NUMBERS_HEADER))))
    return _found(_pairs(rows, NUMBER_FIRST_ROW, 2, 1))


def citations_name_number(lines: Column) -> Column:
    """Lines ``name (number)`` under a combined header."""
    rows = lines_until_next_section(lines, _first(lines, lambda ln: ln.rlike(_u(PAIR_HEADER))))
    return _found(_pairs(rows, PAIR_ROW, 1, 2))


def extract_citations(lines: Column) -> Column:
    """Citations of a document: the first template, in fixed order, that finds any.

    Branches are lazy, so a template is tried only when the ones before it found nothing.
    """

    def first_of(templates: list) -> Column:
        if len(templates) == 1:
            return templates[0](lines)
        return _let(
            templates[0](lines), lambda c: F.when(F.size(c) > 0, c).otherwise(first_of(templates[1:]))
        )

    order = [citations_table, citations_number_first, citations_name_number, citations_two_lists]
    return F.when(F.size(lines) > 0, first_of(order)).otherwise(F.array().cast(CITATION_TYPE))
