"""Counter-based randomness: hashes of (seed, stream, key), so results don't depend on partitions, column order or retries.

The seed is a column literal only inside hashed inputs; None draws a 128-bit secret once, which belongs in the recipe.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadSeed  # type: ignore[attr-defined]


def check_seed(seed: int | str | None) -> str:
    if seed is None:
        return secrets.token_hex(16)
    if isinstance(seed, bool) or (isinstance(seed, (int, float)) and (seed != int(seed) or abs(seed) > 2**31 - 1)):
        raise BadSeed(f"a seed is a whole number within 32 bits, not {seed!r}")
    return str(int(seed)) if isinstance(seed, (int, float)) else seed


def link_seed(seed: str) -> str:
    return f"{seed}#links"


def digest(seed: str, stream: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(stream), key.cast("string")))


def uniform(seed: str, stream: str, key: Column) -> Column:
    """In [0, 1), from 48 bits."""
    return F.conv(F.substring(digest(seed, stream, key), 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)


def uniform_sql(seed: str, stream: str, key: str) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', CAST({key} AS VARCHAR))), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0)"


def digest_sql(seed: str, stream: str, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{stream}', CAST({key} AS VARCHAR)))"
