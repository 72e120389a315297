"""Text column functions with Unicode semantics spelled out, since Spark's defaults are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.schemas import METADATA_MARKER

#: White space as Unicode defines it, and its complement, as Java regular expression classes.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rstrip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), WS + r"+\z", "")


def lstrip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\A" + WS + "+", "")


def strip(x: Column | str) -> Column:
    return rstrip(lstrip(x))


def normalize_newlines(x: Column | str) -> Column:
    """CRLF and CR become LF; white space at both ends goes."""
    return strip(F.regexp_replace(_c(x), r"\r\n?", "\n"))


def tokens(x: Column | str) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), F.lit(0))


def token_set(x: Column | str) -> Column:
    return F.array_distinct(tokens(x))


def token_estimate(x: Column | str) -> Column:
    """The number of runs of characters other than white space."""
    return F.size(F.regexp_extract_all(_c(x), F.lit(NON_WS + "+"), F.lit(0)))


def alpha_ratio(x: Column | str) -> Column:
    """The share of letters; null for an empty text."""
    n = F.length(_c(x))
    return F.when(n > 0, F.length(F.regexp_replace(_c(x), r"[^\p{L}]", "")) / n)


def passes_alpha_filter(x: Column | str, least: float = 0.35) -> Column:
    """False for blank texts and those with too few letters."""
    return F.coalesce((F.length(strip(x)) > 0) & (alpha_ratio(x) >= least), F.lit(False))


def excerpt(x: Column | str, limit: int) -> Column:
    """White space collapsed; beyond the limit cut with three dots."""
    t = F.regexp_replace(strip(x), WS + "+", " ")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(rstrip(F.substring(t, 1, limit - 3)), F.lit("...")))


def head(x: Column | str, limit: int = 400) -> Column:
    """The first characters, with three dots if cut."""
    return F.when(F.length(_c(x)) > limit, F.concat(F.substring(_c(x), 1, limit), F.lit("..."))).otherwise(_c(x))


def first_line_title(x: Column | str) -> Column:
    """At most 80 characters of the first line."""
    line = strip(F.element_at(F.split(strip(x), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1))
    return F.when(F.length(line) > 0, F.substring(line, 1, 80)).otherwise(F.lit("Untitled memory"))


def strip_preamble_search(x: Column | str, marker: str = METADATA_MARKER) -> Column:
    """For searching: the text after the metadata block; unchanged where no blank line ends it."""
    t = lstrip(x)
    parts = F.split(t, r"\r?\n\s*\r?\n", 2)
    return F.when(~F.startswith(t, F.lit(marker)), _c(x)).when(F.size(parts) == 2, lstrip(parts[1])).otherwise(_c(x))


def strip_preamble_candidate(x: Column | str, marker: str = METADATA_MARKER) -> Column:
    """For candidates: the text after the metadata block; empty where no blank line ends it."""
    t = strip(x)
    parts = F.split(t, r"\n\s*\n", 2)
    return F.when(~F.startswith(t, F.lit(marker + " ")), t).when(F.size(parts) == 2, strip(parts[1])).otherwise(F.lit(""))


def strip_preamble_context(x: Column | str, marker: str = METADATA_MARKER) -> Column:
    """For context: what follows the second blank line of a text with metadata (the first, if there is but one)."""
    parts = F.split(_c(x), "\n\n", 3)
    return F.when(F.startswith(_c(x), F.lit(marker)), F.when(F.size(parts) > 1, strip(F.element_at(parts, -1))).otherwise(F.lit(""))).otherwise(_c(x))


def with_preamble(text: Column | str, fields: dict[str, Column], marker: str = METADATA_MARKER) -> Column:
    """The text after a line of metadata: a JSON object with sorted keys, without null and empty values.

    A null text counts as empty; without any value the object is {}.
    """
    parts = []
    for key in sorted(fields):
        value = fields[key]
        written = F.to_json(F.array(value))  # as JSON inside brackets, whatever the type
        parts.append(F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f'"{key}": '), F.substring(written, F.lit(2), F.length(written) - 2))))
    body = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", ")
    return F.concat(F.lit(marker + " {"), body, F.lit("}\n\n"), F.coalesce(_c(text), F.lit("")))


def basename(x: Column | str) -> Column:
    """The last segment of a path with either separator."""
    clean = F.rtrim(F.regexp_replace(strip(x), r"\\", "/"), F.lit("/"))
    return F.element_at(F.split(clean, "/"), -1)


def suffix(x: Column | str) -> Column:
    """The lower-case extension of a path's last segment, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(_c(x), r"[^./\\](\.[^./\\]+)$", 1))


def normalized_path(x: Column | str) -> Column:
    return F.lower(F.rtrim(F.regexp_replace(strip(x), r"\\", "/"), F.lit("/")))


def path_inside(child: Column | str, parent: Column | str) -> Column:
    """Whether a path equals another or lies below it; siblings with a common prefix do not count."""
    c, p = normalized_path(child), normalized_path(parent)
    return (c != "") & (p != "") & ((c == p) | F.startswith(c, F.concat(p, F.lit("/"))))


def physical_path(x: Column | str) -> Column:
    """A source path without its exchange suffix."""
    return F.substring_index(_c(x), "::", 1)


def contains_literal(x: Column | str, needle: str) -> Column:
    """Case-insensitive substring test without wildcards; a null text is empty."""
    return F.instr(F.lower(F.coalesce(_c(x), F.lit(""))), needle.lower()) > 0


def contains_any(x: Column | str, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | contains_literal(x, n)
    return out


def round_half_even(x: Column | str, digits: int) -> Column:
    """Rounds the exact binary value, ties to even, as Python does; Spark's round is decimal half-up."""
    return F.regexp_replace(F.format_number(_c(x), digits), ",", "").cast("double")
