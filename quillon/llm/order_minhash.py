"""Document fingerprints by order MinHash (operator 10). Native: DataFrame functions only.

The k-mers of a text are runs of ``k`` words, each numbered by its occurrence, so repeats count. Their hashes are dealt into
``bins`` by their top bits; of each bin the ``length`` (two) smallest are kept in the order in which they stand in the text, and
that tuple is hashed to 16 bits. The tuples of all bins are the fingerprint. Two fingerprints are as alike as the share of bins
with the same tuple among the bins that either fills, which falls with edits and with changes of order alike.

Everything is arithmetic on one row's arrays: numbers that hold a hash above a position are sorted, so equal hashes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE

BIN_BITS = 6


def fingerprint(df: DataFrame, text: str, out: str, k: int = 2) -> DataFrame:
    """df with ``out`` array<int>: for each filled bin its number above 16 bits of its tuple's hash.

    Null counts as empty; no words give an empty array; fewer than k words are one k-mer. Work per row is n log n in its words.
    """
    top = 64 - BIN_BITS
    steps = {
        "_w": F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), ""),
        "_h": F.expr(f"case when size(_w) = 0 then cast(array() as array<bigint>) when size(_w) < {k} then array(xxhash64(array_join(_w, ' '))) else transform(sequence(0, size(_w) - {k}), i -> xxhash64({', '.join(f'_w[i + {j}]' for j in range(k))})) end"),
        "_m": F.expr("shiftleft(1L, cast(ceil(log2(size(_h) + 2)) as int)) - 1"),
        "_s": F.expr("sort_array(transform(_h, (h, i) -> (h & ~_m) | i))"),
        "_r": F.expr("if(size(_s) = 0, cast(array() as array<int>), filter(sequence(0, size(_s) - 1), i -> i = 0 or (_s[i] & ~_m) <> (_s[greatest(i - 1, 0)] & ~_m)))"),
        "_t": F.expr("sort_array(flatten(transform(_r, (r, j) -> transform(sequence(r, if(j + 1 < size(_r), _r[least(j + 1, size(_r) - 1)], size(_s)) - 1), i -> (xxhash64(_s[r] & ~_m, i - r) & ~_m) | (_s[i] & _m)))))"),
        "_b": F.expr(f"if(size(_t) = 0, cast(array() as array<int>), filter(sequence(0, size(_t) - 1), i -> i = 0 or shiftright(_t[i], {top}) <> shiftright(_t[greatest(i - 1, 0)], {top})))"),
    }
    for name, step in steps.items():
        df = df.withColumn(name, step)
    one, two = "_t[i]", "_t[least(i + 1, size(_t) - 1)]"
    pair = f"if(i + 1 < size(_t) and shiftright({one}, {top}) = shiftright({two}, {top}), if(({one} & _m) < ({two} & _m), xxhash64({one} & ~_m, {two} & ~_m), xxhash64({two} & ~_m, {one} & ~_m)), xxhash64({one} & ~_m))"
    df = df.withColumn(out, F.expr(f"transform(_b, i -> cast(((shiftright({one}, {top}) + {1 << (BIN_BITS - 1)}) * 65536) + ({pair} & 65535) as int))"))
    return df.drop(*steps)


def written(fp: str) -> Column:
    """A fingerprint as text: six hexadecimal digits for each filled bin."""
    return F.array_join(F.transform(F.col(fp), lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1; two empty fingerprints are alike."""
    number = lambda c: F.transform(F.col(c), lambda x: F.shiftright(x, 16))
    filled = F.size(F.array_union(number(a), number(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)
