"""Random numbers from hashes: equal for equal keys, whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SPAN = 4294967296.0


def _key(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def uniform(*keys) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 over the keys."""
    digest = F.md5(F.concat_ws("|", *[_key(k) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_SPAN)


def uniform_between(low, high, *keys) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return low + (high - low) * uniform(*keys)


def normal(*keys) -> Column:
    """A standard normal draw (Box-Muller over two uniforms; 1 - u keeps the log finite)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*keys, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*keys, "a"))


def pick(options: list, *keys) -> Column:
    """One of a short literal list."""
    index = F.floor(uniform(*keys) * F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), index + 1)
