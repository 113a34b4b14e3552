"""Text normalisation, tokens and voltages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.nulls import _c

# The word lists and rewrites that the matching results depend on.
STOP_TOKENS = ["", "a", "b", "c", "the", "and", "or", "to", "from", "kv", "line", "l"]
INTERFACE_WORDS = ["interface", "import", "export", "flowgate", "flow", "tie", "path"]
ABBREVIATIONS = {
    "substation": "sub",
    "station": "sta",
    "switch": "sw",
    "switching": "sw",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}
VOLTAGE = r"(?<!\d)(\d{2,4})\s*kv\b"


def _chain(x: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def normalize_text(x: Column | str) -> Column:
    """Lower case, separators to blanks, "k v" to "kv", long forms of two abbreviations, letters and digits only; null is ''."""
    x = _chain(F.lower(F.coalesce(_c(x), F.lit(""))), [
        (r"[-_./]+", " "), (r"\bk\s*v\b", "kv"), (r"\bxfmer\b", "transformer"), (r"\bser\s+dev\b", "series device"), (r"[^a-z0-9\s]", " "), (r"\s+", " "),
    ])
    return F.trim(x)


def extract_voltage(*values: Column | str) -> Column:
    """The first number of two to four digits before "kv" in the normalised texts, or null."""
    joined = normalize_text(F.concat_ws(" ", *[F.coalesce(_c(v), F.lit("")) for v in values]))
    return F.nullif(F.regexp_extract(joined, VOLTAGE, 1), F.lit("")).try_cast("int")


def tokens(normalized: Column | str) -> Column:
    """Words of a normalised text without stop tokens and pure numbers."""
    return F.filter(F.split(_c(normalized), " "), lambda t: ~t.isin(STOP_TOKENS) & ~t.rlike("^[0-9]+$"))


def unique_tokens(normalized: Column | str) -> Column:
    return F.array_sort(F.array_distinct(tokens(normalized)))


def interface_tokens(normalized: Column | str) -> Column:
    return F.filter(unique_tokens(normalized), lambda t: t.isin(INTERFACE_WORDS) | t.endswith("interface"))


def zone_tokens(zone: Column | str, raw: Column | str) -> Column:
    """Tokens of the zone and the upper-case words of the raw text, lower-cased."""
    caps = F.transform(F.regexp_extract_all(F.coalesce(_c(raw), F.lit("")), F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.concat(tokens(normalize_text(zone)), caps)))


def joined_names(*parts: Column | str) -> Column:
    """Parts joined by " | ", nulls left out."""
    return F.concat_ws(" | ", *[_c(p) for p in parts])


def normalize_node_name(x: Column | str) -> Column:
    """Lower case, punctuation to blanks, word by word abbreviations."""
    plain = F.trim(_chain(F.lower(F.coalesce(_c(x), F.lit(""))), [(r"[-_./]+", " "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")]))
    table = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def name_tokens(normalized: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(_c(normalized), " "), lambda t: t != "")))


def numeric_tokens(normalized: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(normalized), F.lit(r"\d+"), F.lit(0))))


def is_blank(x: Column | str) -> Column:
    return F.coalesce(F.trim(_c(x)) == "", F.lit(False))


def changes_on_trim(x: Column | str) -> Column:
    return F.coalesce(F.trim(_c(x)) != _c(x), F.lit(False))


def relabel(x: Column | str, prefix: str, to: str) -> Column:
    return F.regexp_replace(_c(x), f"^{prefix}", to)
