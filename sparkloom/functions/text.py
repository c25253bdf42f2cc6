"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, n: int, marker: str = "\n... (truncated)") -> Column:
    """At most ``n`` characters, with a marker where some were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def class_guess(name: Column) -> Column:
    """order_line to OrderLine."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")


def plain_type(name: Column) -> Column:
    """A type without arguments, array marks and alternatives."""
    first = F.trim(F.element_at(F.split(name, r"[|&]"), 1))
    return F.regexp_replace(F.regexp_replace(first, r"<.*>", ""), r"(\[\])+$", "")


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s*```(?:\w+)?\s*|\s*```\s*$", ""))


def chain_text(path: Column) -> Column:
    """Names of a call chain joined by arrows."""
    return F.array_join(path, " → ")


def extended_by(names: Column, shown: int = 5) -> Column:
    """The first names and how many more there are."""
    more = F.size(names) - shown
    head = F.array_join(F.slice(names, 1, shown), ", ")
    return F.when(F.size(names) == 0, "").when(more > 0, F.concat(F.lit("Extended by "), head, F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(F.concat(F.lit("Extended by "), head))


def relative_module(module: Column, dots: Column, name: Column) -> Column:
    """A relative import's target: ``dots`` trailing parts of the importing module dropped, the name added."""
    parts = F.split(module, r"\.")
    return F.concat_ws(".", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0))), "."), F.when(name != "", name))


def literal_text(source: Column) -> Column:
    """What a string literal holds: prefix letters and the quotes, single or triple, taken off; other text stays."""
    return F.regexp_replace(F.trim(source), r"^[rRbBuUfF]{0,2}(\"{3}|'{3}|\"|')([\s\S]*)\1$", "$2")


def is_chained(call: Column) -> Column:
    """Whether a call is made on the result of another."""
    return call.rlike(r"\)\.")


def chain_member(call: Column) -> Column:
    """The last member of a chain of calls, without its own brackets; null if there is none."""
    got = F.regexp_extract(call, r"\.([^.()]+)(?:\(\))?$", 1)
    return F.when(got != "", got)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in values])
