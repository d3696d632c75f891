"""Join consecutive chunks of one text, dropping what the seam repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_OVERLAP = 21
CHUNK_OVERLAP = 220


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _longest_seam(tail: Column, head: Column) -> Column:
    """Largest n in [21, …] where the last n of ``tail`` equal the first n of ``head``; else null.

    A seam starts where the first 21 characters of ``head`` occur in ``tail``, and
    the first such place gives the longest one.  Only when that place is no seam
    are all sizes tried.
    """
    longest = F.least(F.length(tail), F.length(head))
    sizes = F.filter(
        F.sequence(F.greatest(longest, F.lit(MIN_OVERLAP)), F.lit(MIN_OVERLAP), F.lit(-1)),
        lambda n: F.right(tail, n) == F.left(head, n),
    )
    size_at = lambda place: F.length(tail) - place + 1
    is_seam = lambda place: (size_at(place) <= longest) & (
        F.right(tail, size_at(place)) == F.left(head, size_at(place))
    )
    found = _let(
        F.instr(tail, F.left(head, F.lit(MIN_OVERLAP))),
        lambda place: F.when(place == 0, F.lit(None).cast("int"))
        .when(is_seam(place), size_at(place))
        .otherwise(F.get(sizes, F.lit(0))),
    )
    return F.when(longest >= MIN_OVERLAP, found)


def concat_dedup_overlap(texts: Column, max_overlap: int = CHUNK_OVERLAP) -> Column:
    """Fold an ordered array of texts into one: the overlap once, else a blank line between."""

    def join(left: Column, right: Column) -> Column:
        seam = _longest_seam(F.right(left, F.lit(max_overlap)), F.left(right, F.lit(max_overlap)))
        return _let(
            seam,
            lambda n: F.when(n.isNotNull(), F.concat(left, F.substring(right, n + 1, F.length(right)))).otherwise(
                F.concat(left, F.lit("\n\n"), right)
            ),
        )

    rest = F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))
    return F.when(F.size(texts) == 0, "").otherwise(F.aggregate(rest, F.element_at(texts, 1), join))
