"""Poems brought to five lines, short ones by asking for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.functions import prompts as PR
from verity.functions import text as T
from verity.operators.responses import Answer


def five_lines(poems: DataFrame, text: str, answer: Answer) -> DataFrame:
    """``poems`` (with a ``model``) and ``poem``: five lines as they are, the first five
    of more, and for fewer one further line, which the model is asked for with the
    poem's last line in the prompt (a dependent call: its prompt is built from the answer
    before). Of that answer the first line counts. ``asked`` says where that was,
    ``error`` what the call gave; a poem without any line is asked with an empty one."""
    lines = poems.withColumns({"_lines": T.nonblank_lines(text)})
    n = F.size("_lines")
    ready = lines.where(n >= T.POEM_LINES).withColumns({"poem": T.first_lines("_lines"), "asked": F.lit(False), "error": F.lit(None).cast("string")})
    short = lines.where(F.coalesce(n, F.lit(0)) < T.POEM_LINES)
    last = F.when(n > 0, F.element_at("_lines", -1)).otherwise("")
    prompt = PR.fill(PR.POEM_APPEND, diff=T.POEM_LINES - F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), line=last)
    called = answer(short.withColumn("prompt", prompt))
    first = F.element_at(F.split("response", "\n"), 1)
    grown = F.when(F.col("response").isNotNull(), F.concat(F.coalesce("_lines", F.array().cast("array<string>")), F.array(first))).otherwise(F.col("_lines"))
    asked = called.withColumns({"poem": F.array_join(F.slice(grown, 1, T.POEM_LINES), "\n"), "asked": F.lit(True)})
    columns = [*poems.columns, "poem", "asked", "error"]
    return ready.select(columns).unionByName(asked.select(columns))
