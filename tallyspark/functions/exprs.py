"""Scalar column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.schemas import ACCOUNT_CLASSES, MONEY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in(c, values) -> Column:
    """``~isin`` that keeps nulls, as pandas does."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_contains(c, text: str) -> Column:
    """Null-safe "does not contain"."""
    return ~F.coalesce(col(c).contains(text), F.lit(False))


def ne_zero_keep_null(c) -> Column:
    """``c != 0`` with pandas semantics: null rows are kept."""
    return ~col(c).eqNullSafe(F.lit(0))


def num(c) -> Column:
    """Cell text -> DOUBLE for numeric comparisons; text stays null."""
    return col(c).try_cast("double")


def op_to_sign(op) -> Column:
    """Operator text -> sign: '+' 1, '-'/'_' -1, blank/null 0, else null.

    No trimming here: ' +' is an unknown operator."""
    o = col(op)
    return (F.when(o.isNull() | (o == ""), F.lit(0))
            .when(o == "+", F.lit(1))
            .when(o.isin("-", "_"), F.lit(-1)))


def parse_thousands(c) -> Column:
    """'1,234.50' -> 1234.50 as DECIMAL(18,2); null if it is no number."""
    return F.regexp_replace(col(c), ",", "").try_cast(MONEY)


def parse_trailing_minus(c) -> Column:
    """'1,234.50-' -> -1234.50; any '-' anywhere makes it negative; null if it
    is no number (see :func:`tallyspark.operators.ledger.ledger_rejects`)."""
    s = col(c).cast("string")
    mag = magnitude(c)
    return F.when(s.contains("-"), -mag).otherwise(mag)


def magnitude(c) -> Column:
    """:func:`parse_trailing_minus` without the sign."""
    return F.translate(col(c).cast("string"), ",-", "").try_cast(MONEY)


def account_class(code) -> Column:
    first = F.substring(col(code), 1, 1)
    e = None
    for digit, label in ACCOUNT_CLASSES:
        e = (F.when(first == digit, F.lit(label)) if e is None
             else e.when(first == digit, F.lit(label)))
    return e


def as_text_label(c) -> Column:
    """Prefix "'" to non-null values; null stays null."""
    return F.when(col(c).isNotNull(), F.concat(F.lit("'"), col(c).cast("string")))


def strip_text(c) -> Column:
    """Text without white space at its ends: every Unicode space, the
    full-width one and line ends included, and the separators U+001C to U+001F."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def base_name(path) -> Column:
    """Last path segment for '/' or '\\' separated paths."""
    return F.element_at(F.split(col(path), r"[/\\]"), -1)


def col_letters_to_no(letters) -> Column:
    """'A' -> 0, 'Z' -> 25, 'AA' -> 26 (zero-based column number)."""
    s = F.upper(col(letters))
    n = F.length(s)
    total = F.lit(0)
    for i in range(1, 4):
        ch = F.when(n >= i, F.ascii(F.substring(s, -i, 1)) - 64).otherwise(0)
        total = total + ch * (26 ** (i - 1))
    return (total - 1).cast("int")


def col_no_to_letters(col_no) -> Column:
    """Zero-based column number -> letters (up to three letters)."""
    n = col(col_no).cast("int") + 1

    def letter(k):
        return F.char((F.lit(64) + k).cast("long"))

    one = letter(n)
    two = F.concat(letter(F.floor((n - 27) / 26) + 1), letter((n - 27) % 26 + 1))
    r3 = (n - 703) % 676
    three = F.concat(letter(F.floor((n - 703) / 676) + 1), letter(F.floor(r3 / 26) + 1),
                     letter(r3 % 26 + 1))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)


def cell_ref(col_no, row_no) -> Column:
    return F.concat(col_no_to_letters(col_no), col(row_no).cast("string"))


def cell_ref_col(ref) -> Column:
    return col_letters_to_no(F.regexp_extract(col(ref), r"^([A-Za-z]+)", 1))


def cell_ref_row(ref) -> Column:
    return F.regexp_extract(col(ref), r"([0-9]+)$", 1).cast("int")
