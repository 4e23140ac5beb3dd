"""Hash-based randomness: the draw of a row depends on its key only, never on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number of hexadecimal digits used for a uniform draw: 52 bits fit a double exactly.
HEX_DIGITS = 13


def draw_key(seed: int, purpose: str, *parts: Column | int | str) -> Column:
    """md5 text of ``seed:purpose:part:part``; ascending order of it is a random order."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = [F.lit(f"{seed}:{purpose}")] + [c.cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *text).cast("binary"))


def key_to_uniform(key: Column) -> Column:
    """Uniform number in [0, 1) from a draw key."""
    digits = F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("double")
    return digits / F.lit(float(16**HEX_DIGITS))


def uniform(seed: int, purpose: str, *parts: Column | int | str) -> Column:
    return key_to_uniform(draw_key(seed, purpose, *parts))


def among_lowest(key: Column, n: int, rows: int) -> Column:
    """Whether a draw key can be among the ``n`` lowest of ``rows`` keys.

    The threshold lets about ``n + 12 sqrt(n) + 100`` keys pass; fewer than ``n`` of them have a chance below 1e-30.
    """
    share = (n + 12 * n**0.5 + 100) / max(rows, 1)
    return F.lit(True) if share >= 1 else key < F.lit(format(int(share * 16**HEX_DIGITS), f"0{HEX_DIGITS}x"))


def sign(seed: int, purpose: str, *parts: Column | int | str) -> Column:
    """+1.0 or -1.0 with equal chance."""
    return F.when(uniform(seed, purpose, *parts) < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
