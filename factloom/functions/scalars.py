"""Scalar functions, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lower_by_rune(c: Column) -> Column:
    """Lower case letter by letter: a final capital sigma and a dotted capital I need help."""
    return F.lower(F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def split_words(c: Column | str) -> Column:
    """Lower-case words of an identifier, in order: breaks at anything but letters and digits,
    between lower and upper case, and before the last capital of a run that a small letter follows."""
    c = F.col(c) if isinstance(c, str) else c
    spaced = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.transform(F.filter(F.split(spaced, r"[^\p{L}\p{Nd}]+"), lambda w: w != ""), _lower_by_rune)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def first_non_empty(*columns: Column | str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit(""))


def dirname(c: Column | str) -> Column:
    """Directory of a path: "." without a slash, "" of ""."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "", "").when(~c.contains("/"), ".").otherwise(F.regexp_replace(c, "/[^/]*$", ""))


def stem(c: Column | str) -> Column:
    """File name without its last extension."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"\.[^.]*$", "")


def split_list(c: Column | str) -> Column:
    """Parts of a comma list, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def whole_number(c: Column) -> Column:
    """The value of a plain decimal integer, else 0 (blanks around it are not allowed)."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), F.lit(0).cast("bigint"))


def line_range(c: Column | str) -> Column:
    """struct(startLine, endLine) of "l:c-l:c"; "" is (1, 1); anything else is null."""
    c = F.col(c) if isinstance(c, str) else c
    form = r"^([0-9]+)(?::[^-]*)?-([0-9]+)(?::[^-]*)?$"
    one = lambda g: F.regexp_extract(c, form, g).try_cast("int")
    both = F.struct(one(1).alias("startLine"), one(2).alias("endLine"))
    return F.when(c == "", F.struct(F.lit(1).alias("startLine"), F.lit(1).alias("endLine"))).when(c.rlike(form), both)


def ellipsis(c: Column, most: int = 32) -> Column:
    """The value with its middle cut out where it is longer than ``most``."""
    half = most // 2 - 1
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit("…"), F.right(c, F.lit(half)))).otherwise(c)


def classify_loading(c: Column) -> Column:
    """Diagnostic status of a package loader's message."""
    low = F.lower(c)
    missing = ("no required module provides package", "cannot find module providing package", "module found, but does not contain package", "missing go.sum entry")
    hit = F.lit(False)
    for m in missing:
        hit = hit | low.contains(m)
    return F.when(low.contains("import cycle"), "import_cycle").when(hit, "missing_dependency").otherwise("package_loading_diagnostic")


def proof_status(c: Column) -> Column:
    return F.when(c.isin("unknown", "analysis_error"), c).otherwise("exists")


def is_local_path(c: Column) -> Column:
    return c.isin(".", "..") | c.startswith("./") | c.startswith("../") | c.startswith("/")


def normal_name(c: Column) -> Column:
    """A section name without case, underscores, dashes and blanks."""
    return F.lower(F.translate(c, "_- ", ""))


def middle_cut(value: Column | str, most: int) -> Column:
    """At most ``most`` characters: the middle of longer texts becomes an ellipsis."""
    c, head, tail = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")), most // 2, (most - 1) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail))))


def escape_html(value: Column | str) -> Column:
    c = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c
