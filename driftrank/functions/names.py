"""Column builders over dotted names, paths and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf(s: Column) -> Column:
    return F.substring_index(s, ".", -1)


def root(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def module_of(s: Column) -> Column:
    """The text before the last dot; the name itself where it has none."""
    return F.regexp_replace(s, r"\.[^.]*$", "")


def depth(s: Column) -> Column:
    """Number of dots."""
    return F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))


def is_top_level(s: Column) -> Column:
    return depth(s) == 1


def name_length(s: Column) -> Column:
    return F.length(leaf(s))


def is_private(s: Column, exports: Column | None = None) -> Column:
    """Some part starts with one underscore, unless the leaf is exported."""
    hidden = F.exists(F.split(s, r"\."), lambda p: p.startswith("_") & ~p.startswith("__"))
    return hidden if exports is None else hidden & ~F.coalesce(F.array_contains(exports, leaf(s)), F.lit(False))


def is_dunder(s: Column) -> Column:
    return F.exists(F.split(s, r"\."), lambda p: p.startswith("__") & p.endswith("__") & (F.length(p) > 4))


def looks_like_method(s: Column) -> Column:
    """The part before the leaf starts with a capital."""
    parts = F.split(s, r"\.")
    return (F.size(parts) >= 2) & F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).rlike(r"^\p{Lu}")


def canonical(name: Column) -> Column:
    """Lower case, each run of `-`, `_`, `.` one dash."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def squeezed(name: Column) -> Column:
    """Lower case without `-`, `_`, `.`."""
    return F.lower(F.regexp_replace(name, "[-_.]", ""))


def one_line(text: Column, most: int = 200) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def without_colour(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def without_location(text: Column) -> Column:
    """Drops a leading `path.py:line: `."""
    return F.regexp_replace(text, r"^[^\s:]+:\d+:\s*", "")


def value_of(text: Column, key: str) -> Column:
    """`key=value` out of prose, null when absent."""
    return F.nullif(F.regexp_extract(text, rf"\b{key}=([^\s,;]+)", 1), F.lit(""))


def quoted_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))


# First path parts that are no owner.
RESERVED_OWNERS = ("sponsors", "orgs", "users", "apps")


def repository(url: Column) -> Column:
    """owner/repo of a code-host URL, without `.git`; null for others and reserved owners."""
    parts = F.split(F.regexp_extract(url, r"(?i)^https?://(?:www\.)?github\.com/(.*)$", 1), "/")
    owner = F.regexp_extract(parts[0], r"^[\w.-]+$", 0)
    repo = F.regexp_replace(F.regexp_extract(F.get(parts, F.lit(1)), r"^[\w.-]+", 0), r"(?i)\.git$", "")
    return F.when((owner != "") & (repo != "") & ~F.lower(owner).isin(*RESERVED_OWNERS), F.concat_ws("/", owner, repo))


def flag(value: Column) -> Column:
    """Text to boolean: true, 1, yes, t, y are true; the rest, null included, is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "t", "y"), F.lit(False))


def number(value: Column) -> Column:
    """Text booleans as 1 and 0, numbers as they are, anything else null."""
    s = F.lower(F.trim(value.cast("string")))
    return F.when(s == "true", 1.0).when(s == "false", 0.0).otherwise(F.nullif(s.try_cast("double"), F.lit(float("nan"))))


def is_test_code(path: Column) -> Column:
    """Some part is `tests` or starts with `test_`."""
    return F.exists(F.split(path, r"[./]"), lambda p: (p == "tests") | p.startswith("test_"))


def grade(n: Column, positive: Column) -> Column:
    """0 for a negative; a positive gets ceil(ln(1 + n)) within 1 to 4."""
    g = F.least(F.greatest(F.ceil(F.log1p(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("double"))), F.lit(1)), F.lit(4))
    return F.when(positive, g).otherwise(0).cast("int")


def gain(g: Column) -> Column:
    return F.pow(F.lit(2.0), g) - 1


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def instant(text: Column) -> Column:
    """ISO dates and date-times with or without offset, in UTC; null where unreadable."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), text.try_cast("timestamp"))
