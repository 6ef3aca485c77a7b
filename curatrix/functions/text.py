"""Column expressions over text. All stay in the JVM; a null argument gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(s: Column) -> Column:
    """Words between single spaces; two spaces in a row hold an empty word."""
    return F.split(s, " ", -1)


def last_word(s: Column) -> Column:
    return F.element_at(words(s), -1)


def first_word(s: Column) -> Column:
    return F.element_at(words(s), 1)


def after_last(s: Column, mark: str) -> Column:
    """What follows the last `mark`; all of s if there is none."""
    return F.split_part(s, F.lit(mark), F.lit(-1))


def part_after(s: Column, mark: str) -> Column:
    """What stands between the first and the second `mark`; null if there is none."""
    return F.when(F.contains(s, F.lit(mark)), F.split_part(s, F.lit(mark), F.lit(2)))


def strip(s: Column, chars: str) -> Column:
    return F.trim(s, F.lit(chars))


def has_word(s: Column, word: Column) -> Column:
    return F.array_contains(words(s), word)


def has_any(s: Column, parts: list[str]) -> Column:
    """Whether one of `parts` is a substring of s."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(s, F.lit(p))
    return out


def ends_with_any(s: Column, ends: list[str]) -> Column:
    return s.rlike("(" + "|".join(ends) + ")$")


def count_of(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def drop_trailing_parens(s: Column) -> Column:
    return F.regexp_replace(s, r"\s*\([^)]*\)$", "")


def drop_punctuation(s: Column) -> Column:
    """s without what is neither a letter, a number, an underscore nor white space, in any script."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}_\p{Z}\x09-\x0D\x1C-\x1F\x85]", "")


def join_hyphens(s: Column) -> Column:
    return F.regexp_replace(s, r"([\p{L}\p{N}_]+)-([\p{L}\p{N}_]+)", "$1$2")


def quoted(s: Column) -> Column:
    """What stands in single quotes, in order."""
    return F.regexp_extract_all(s, F.lit("'(.*?)'"), F.lit(1))


def caption(s: Column) -> Column:
    """Lower case, without white space around it, ending in a full stop."""
    t = F.lower(F.trim(s))
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def file_key(path: Column) -> Column:
    """What follows the last underscore, up to the first full stop."""
    return F.split_part(F.split_part(path, F.lit("_"), F.lit(-1)), F.lit("."), F.lit(1))


def path_name(path: Column) -> Column:
    """The second-last part between full stops, from its last slash on."""
    return F.element_at(F.split(F.element_at(F.split(path, r"\."), -2), "/"), -1)


def repair_json(s: Column) -> Column:
    """A generated object cut after its first closing brace, or closed if it has none."""
    return F.when(~F.contains(s, F.lit("}")), F.concat(s, F.lit("}"))).otherwise(F.concat(F.substring_index(s, "}", 1), F.lit("}")))


def slices(items: Column, sizes: Column) -> Column:
    """The items as arrays of the given sizes, one after the other; an error if these don't add up to all of them."""
    ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    parts = F.zip_with(ends, sizes, lambda e, n: F.slice(items, (e - n + 1).cast("int"), n.cast("int")))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total == F.size(items), parts).otherwise(F.raise_error(F.lit("the sizes don't add up to the items")))


def shorten(s: Column, tokens: Callable[[Column], Column], limit: int = 77) -> Column:
    """A caption of more than `limit` tokens cut after its first sentence; if that is still longer, after its first
    clause; if that is, after `limit` words. tokens: counts those of a text."""
    sentence = F.when(tokens(s) > limit, F.concat(F.split_part(s, F.lit(". "), F.lit(1)), F.lit("."))).otherwise(s)
    clause = F.when(tokens(sentence) > limit, F.concat(F.split_part(sentence, F.lit(", "), F.lit(1)), F.lit("."))).otherwise(sentence)
    return F.when(tokens(clause) > limit, F.array_join(F.slice(words(clause), 1, limit), " ")).otherwise(clause)
