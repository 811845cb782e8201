"""Joining one-row-per-key facts to rows whose keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys with this many rows or more are hot. There are at most rows / HOT_ROWS of them,
# which bounds the broadcast: ten thousand for ten billion rows.
HOT_ROWS = 1_000_000
_SPREAD = 1 << 20


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str | list[str],
    weight: str,
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the columns of `facts` to `rows` on `key`.

    `facts` has one row per key and in `weight` the number of rows the key has. Hot keys
    are joined by broadcast and their rows are then spread over all tasks of the join of
    the other keys by the hash of `spread_by`, so that no task gets a whole hot key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    added = [c for c in facts.columns if c not in (*keys, weight)]
    is_hot = f"`{weight}` >= {hot_rows}"
    hot = facts.where(is_hot).selectExpr(
        *keys, "true as _hot", *[f"`{c}` as `_hot_{c}`" for c in added]
    )
    # Always 0 here, but no literal: a literal would be folded out of the join keys.
    salt_here = f"cast({is_hot} as int) as _salt"
    cold = facts.where(f"not ({is_hot})").selectExpr(
        *keys, salt_here, "true as _cold", *[f"`{c}` as `_cold_{c}`" for c in added]
    )
    # Rows without a key match nothing and are spread like those of a hot key.
    spread = f"cast(1 + pmod(xxhash64(`{spread_by}`), {_SPREAD}) as int)"
    salt = f"case when _hot or `{keys[0]}` is null then {spread} else 0 end"
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.expr(salt))
        .join(cold, [*keys, "_salt"], "left")
    )
    if how == "inner":
        joined = joined.where("_hot or _cold")
    return joined.selectExpr(
        *[f"`{c}`" for c in rows.columns],
        *[f"coalesce(`_hot_{c}`, `_cold_{c}`) as `{c}`" for c in added],
    )
