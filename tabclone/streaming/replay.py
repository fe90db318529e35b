"""A recipe on a stream: stateless joins with its maps; an unknown value fails the batch it arrives in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.recipe import Recipe


def forward_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """Whole-table checks can't hold for a stream, so the integrity mark is not compared."""
    return recipe.forward(stream, check_integrity=False)


def inverse_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    return recipe.inverse(stream)


def replay(stream: DataFrame, recipe: Recipe, path: str, checkpoint: str, inverse: bool = False) -> StreamingQuery:
    """Writes what is there to Parquet and stops; started again, it goes on where it was."""
    done = inverse_stream(stream, recipe) if inverse else forward_stream(stream, recipe)
    return done.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
