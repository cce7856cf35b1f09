"""Queries of 2J: pluggable inference over rows."""

from __future__ import annotations

from servelog.catalog import views
from servelog.catalog.common import r6
from servelog.operators import infer


def _letters():
    """A model that finds the share of vowels in a text; a batch takes its characters' time."""
    def predict(texts):
        vowels = [sum(text.count(v) for v in "aeiou") for text in texts]
        return [f"{n} of {len(t)}" for n, t in zip(vowels, texts)], sum(map(len, texts)) / 1000
    return predict


def batch_infer(spark, sf_dir):
    """Whole documents in batches of 16 by seq, as many as the table gives."""
    rows = views.prompt_log(spark, sf_dir).select("seq", "text")
    got = infer.batch_infer(rows, "text", _letters, order="seq")
    return got.select("seq", "output", "batch_size", r6("inference_ms"))


QUERIES = {"batch_infer": batch_infer}

SQL = {"batch_infer": """
WITH numbered AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS b FROM documents)
SELECT doc_id AS seq, length(regexp_replace(text, '[^aeiou]', '', 'g')) || ' of ' || length(text) AS output,
  (count(*) OVER (PARTITION BY b))::INTEGER AS batch_size,
  round(sum(length(text)) OVER (PARTITION BY b) / 1000.0::DOUBLE, 6) AS inference_ms FROM numbered"""}
