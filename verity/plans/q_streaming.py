"""Registered stream-shaped and model-call queries: R2 (its batch form; the
stream itself is exercised in tests) and U1 (mapInPandas echo client)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.operators import inference as INF
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.sources import fixtures as X
from verity.streaming.usage import usage_per_window


@register("r2_usage_per_window", f"""WITH {O.REQUEST_LOG}
SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day, '%Y-%m-%d %H:%M:%S') AS window_end,
       model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens
FROM request_log GROUP BY 1, 2, model""")
def r2_usage_per_window(spark, sf_dir):
    """R2: requests and tokens per day window and model over the request log
    (batch form of the streaming job; equal on closed windows)."""
    return usage_per_window(X.request_log(spark, sf_dir))


def picky_client_factory():
    """A client without a network: it echoes, and refuses every batch that
    holds a prompt whose length is a multiple of five."""
    def client(prompts):
        if any(len(p) % 5 == 0 for p in prompts):
            raise ValueError("refused")
        return list(prompts)
    return client


@register("u1_batch_inference", f"""WITH {O.RECORDED}
SELECT conv_id, turn, CASE WHEN length(coalesce(prompt, '')) % 5 <> 0 THEN prompt END AS response,
       CASE WHEN length(coalesce(prompt, '')) % 5 = 0 THEN 'refused' END AS error
FROM recorded_responses""")
def u1_batch_inference(spark, sf_dir):
    """Every recorded user prompt sent through ``mapInPandas`` to a client
    made once per partition; only the prompts that it refuses fail."""
    r = X.recorded_responses(spark, sf_dir).select("conv_id", "turn", "prompt")
    g = INF.generate(r, "prompt", picky_client_factory)
    return g.select("conv_id", "turn", "response", F.col("error"))
