"""Chat messages as one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles of a prompt.
ROLES = ("system", "user", "assistant")


def prompts(turns: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A line "<role> content" for each turn in order, other roles left out, then "<assistant>"."""
    known = turns.withColumn("_line", F.when(F.col(role).isin(*ROLES), F.concat(F.lit("<"), role, F.lit("> "), F.coalesce(text, F.lit("")))))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(turn, "_line"))), lambda s: s["_line"])  # one conversation's turns
    return known.groupBy(by).agg(F.concat(F.array_join(F.concat(F.filter(lines, lambda x: x.isNotNull()), F.array(F.lit("<assistant>"))), "\n")).alias("prompt"))
