"""File and folder name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space of any script
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(name: Column) -> Column:
    """Last dot and what follows, when something other than dots stands before it; else empty."""
    n = F.length(F.substring_index(name, ".", -1))
    before = F.left(name, F.length(name) - n - 1)
    return F.when(F.contains(name, F.lit(".")) & (F.ltrim(before, F.lit(".")) != ""), F.right(name, n + 1)).otherwise("")


def without_extension(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(extension(name)))


def stem(name: Column) -> Column:
    return F.lower(without_extension(name))


def variants(a: Column, b: Column) -> Column:
    """Two stems name one picture: equal, or one starts with the other and goes on with a non-digit."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    rest = F.substring(long, F.length(short) + 1, F.lit(1))
    return (a == b) | (F.startswith(long, short) & (F.length(rest) > 0) & ~rest.between("0", "9"))


def open_prefixes(name: Column) -> Column:
    """Every proper prefix of a stem that is followed by a non-digit."""
    cuts = F.when(F.length(name) > 1, F.sequence(F.lit(1), F.length(name) - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(cuts, lambda n: ~F.substring(name, n + 1, F.lit(1)).between("0", "9"))
    return F.transform(kept, lambda n: F.substring(name, F.lit(1), n))


def add_suffix(name: Column, suffix: Column) -> Column:
    """Put ``suffix`` before the extension."""
    return F.concat(without_extension(name), suffix, extension(name))


def clean_tag(tag: Column) -> Column:
    """Folder-safe tag: illegal characters become the fixed mark, white space goes, 100 characters stay."""
    # fixed values: the nine characters a folder name must not hold and their replacement
    return F.substring(F.regexp_replace(F.regexp_replace(tag, r'[/\\:*?"<>|]', "、"), WHITE_SPACE + "+", ""), 1, 100)


def dated_tag(day: Column, tag: Column) -> Column:
    """Prefix the day unless the tag starts with it; a day further inside is taken out first."""
    return F.when(F.startswith(tag, day), tag).otherwise(
        F.concat(day, F.lit("-"), F.regexp_replace(F.replace(tag, day, F.lit("")), "^-+", ""))
    )


def saved_name(name: Column, is_exact: Column) -> Column:
    """Name on disk: a mark before the extension when the time is a guess."""
    return F.when(is_exact, name).otherwise(add_suffix(name, F.lit("_NoEXIF")))
