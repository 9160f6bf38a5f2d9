"""How alike two column names are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed
from .text import trimmed

NAME_LIMIT = 128


def name_tokens(c: Column) -> Column:
    """Lower-case words of an identifier, split at case changes and at anything not a letter or digit."""
    spaced = F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda w: w != "")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.substring(a, 1, NAME_LIMIT), F.substring(b, 1, NAME_LIMIT))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard share of matching words, where a word of three letters or more also matches what it begins.

    Words pair off one to one, the earliest free partner first, so the fold carries the free partners.
    """
    def alike(x: Column, y: Column) -> Column:
        return (x == y) | ((F.length(x) >= 3) & y.startswith(x)) | ((F.length(y) >= 3) & x.startswith(y))

    def pair_off(free: Column, word: Column) -> Column:
        hit = F.array_min(F.transform(free, lambda y, i: F.when(alike(word, y), i)))
        return _once(hit, lambda h: F.when(h.isNull(), free).otherwise(F.filter(free, lambda y, i: i != h)))

    def share(words: Column) -> Column:
        n_left, n_right = F.size(words["a"]), F.size(words["b"])
        left_over = F.size(F.aggregate(words["a"], words["b"], pair_off))
        # Matches are the partners used up; the union counts them once.
        return F.coalesce(F.try_divide(n_right - left_over, n_left + left_over), F.lit(1.0))

    return _once(_pair(name_tokens(a), name_tokens(b)), share)


def name_similarity(a: Column, b: Column) -> Column:
    """Edit distance (0.4), word overlap (0.5) and a containment bonus (0.2), between 0 and 1."""
    def clean(c: Column) -> Column:
        return trimmed(F.lower(F.substring(c, 1, NAME_LIMIT)))

    def score(names: Column) -> Column:
        x, y = names["a"], names["b"]
        edits = 1 - F.try_divide(edit_distance(x, y), F.greatest(F.length(x), F.length(y)))
        contained = ((F.length(x) >= 3) & y.contains(x)) | ((F.length(y) >= 3) & x.contains(y))
        blend = 0.4 * edits + 0.5 * token_overlap(x, y) + F.when(contained, 0.2).otherwise(0.0)
        return F.when(x == y, F.lit(1.0)).otherwise(_once(blend, lambda v: F.least(F.lit(1.0), fixed(v, 3))))

    return _once(_pair(clean(a), clean(b)), score)
