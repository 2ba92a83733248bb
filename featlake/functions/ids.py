"""Column expressions for id and dense features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this many slots a padded list is written out element by element, which
# keeps the projection inside whole-stage code generation. Longer lists use one
# higher-order function: a generated method over 8000 bytes of bytecode is left
# to the interpreter by the JVM and runs many times slower.
UNROLL_UP_TO = 8


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positive_or_zero(c: Column | str) -> Column:
    """Null, negative and zero ids all become 0, the padding id."""
    c = as_column(c)
    return F.when(c > 0, c).otherwise(F.lit(0)).cast("bigint")


def in_vocab_or_zero(c: Column | str, vocab: int) -> Column:
    """Keep ids in ``[1, vocab)``; everything else is 0. A vocab of 0 zeroes the feature."""
    if vocab <= 0:
        return F.lit(0).cast("bigint")
    c = as_column(c)
    return F.when((c > 0) & (c < vocab), c).otherwise(F.lit(0)).cast("bigint")


def used_length(c: Column | str, limit: int) -> Column:
    """Number of list elements that survive the cut at ``limit``; 0 for a null list."""
    return F.least(F.coalesce(F.array_size(as_column(c)), F.lit(0)), F.lit(limit))


def fixed_width(c: Column | str, width: int, element: Callable[[Column], Column], type_name: str) -> Column:
    """First ``width`` elements of a list, each passed through ``element``.

    ``element`` sees null for a position past the end and decides the padding.
    In the long form it only visits elements that exist; the padding is one
    value, repeated.
    """
    c = as_column(c)
    kind = f"array<{type_name}>"
    if width <= 0:
        return F.array().cast(kind)
    if width <= UNROLL_UP_TO:
        return F.array(*[element(F.get(c, F.lit(i))) for i in range(width)])
    kept = F.transform(F.slice(F.coalesce(c, F.array().cast(kind)), 1, width), element)
    padding = element(F.lit(None).cast(type_name))
    return F.concat(kept, F.array_repeat(padding, F.lit(width) - used_length(c, width)))


def pad_ids(c: Column | str, width: int, vocab: int | None = None) -> Column:
    """Cut and right-pad an id list to ``width``; with ``vocab``, drop ids outside it too."""
    element = positive_or_zero if vocab is None else lambda x: in_vocab_or_zero(x, vocab)
    return fixed_width(c, width, element, "bigint")


def pad_dense(c: Column | str, width: int) -> Column:
    """Cut and right-pad a float list with 0.0; negative values stay."""
    zero = F.lit(0.0).cast("float")
    return fixed_width(c, width, lambda x: F.coalesce(x.cast("float"), zero), "float")


def segment(vector: Column | str, offset: int, length: int) -> Column:
    """The part of a flattened vector that belongs to one feature."""
    return F.slice(as_column(vector), offset + 1, length)


def conversion_label(label_type: Column | str, with_label: bool = True) -> Column:
    """1 when ``label_type`` is 2, else 0; constant 0 when labels are not wanted."""
    if not with_label:
        return F.lit(0)
    return F.when(as_column(label_type) == 2, 1).otherwise(0)


def padding_mask(length: Column | str, width: int) -> Column:
    """True at positions that hold padding, i.e. at and after ``length``."""
    length = as_column(length)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i >= length)


def equal_chunks(vector: Column | str, total: int, n_chunks: int) -> Column:
    """Zero-pad a vector of ``total`` values at its end and cut it into equal parts."""
    vector = as_column(vector)
    width = -(-total // n_chunks)
    missing = width * n_chunks - total
    if missing:
        vector = F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), missing))
    return F.array(*[F.slice(vector, i * width + 1, width) for i in range(n_chunks)])
