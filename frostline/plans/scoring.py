"""Queries over scores of prompts: three ways to read a model's answer, and a run that is broken off and resumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.functions import text
from frostline.operators import scoring
from frostline.plans.base import IX, h, pairs, query
from frostline.sources.storage import new_path, stored
from frostline.sources.tables import table

_X = "'Would they buy it?' || chr(10) || 'User ' || user_id || ', product ' || p_name"
_PROMPTS = {
    "legacy": f"'[INST] ' || {_X} || ' [/INST] '",
    "llama3": f"'<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || {_X} || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)",
    "qwen": f"'<|im_start|>user' || chr(10) || {_X} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)",
}
_NEXT = f"1 / (1 + exp((({h('prompt', 't0')} % 2001 - 1000) - ({h('prompt', 't1')} % 2001 - 1000)) / 250.0::DOUBLE))"
_LOG = lambda k: f"CASE WHEN {h('prompt', f's{k}')} % 17 = 0 THEN NULL ELSE -({h('prompt', f's{k}')} % 5000) / 1000.0::DOUBLE END"
_SEQ = f"(SELECT CASE WHEN l1 IS NULL THEN 0 WHEN l0 IS NULL THEN 1 ELSE 1 / (1 + exp(l0 - l1)) END FROM (SELECT {_LOG(0)} AS l0, {_LOG(1)} AS l1))"
_TWO = f"lpad(CAST({h('prompt', 'v')} % 100 AS VARCHAR), 2, '0')"
_SAID = f"CASE {h('prompt', 'g')} % 5 WHEN 0 THEN '0.' || {_TWO} WHEN 1 THEN 'Probability: 0.' || {_TWO} || '.' WHEN 2 THEN '1' WHEN 3 THEN 'I can''t tell' ELSE 'about 1.0' END"
_READ = f"CASE {h('prompt', 'g')} % 5 WHEN 2 THEN 1 WHEN 3 THEN 0.5 WHEN 4 THEN 1 ELSE ({h('prompt', 'v')} % 100) / 100.0::DOUBLE END"
_EXAMPLES = f"{IX}, ex AS (SELECT user_id, item_id, p_name FROM ix JOIN part ON p_partkey = item_id)"


def _examples(spark, d):
    return stored(pairs(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id").select("user_id", "item_id", "p_name"))


def _prompt(template: str):
    return text.chat(template, F.lit("Would they buy it?"), F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(", product "), F.col("p_name")))


def _mode_sql(mode: str, template: str, p: str, said: str = "''") -> str:
    return f"SELECT user_id, item_id, '{mode}' AS mode, round({p}, 6) AS p, {said} AS generation FROM (SELECT *, {_PROMPTS[template]} AS prompt FROM ex)"


@query(f"WITH {_EXAMPLES} {_mode_sql('next_token', 'legacy', _NEXT)} UNION ALL {_mode_sql('sequence', 'llama3', _SEQ)} UNION ALL {_mode_sql('generate', 'qwen', _READ, _SAID)}")
def scores_by_mode(spark, d):
    """All pairs scored by the labels' next-token logits, by the labels' sequences and by what is generated (of a stand-in model)."""
    ex, out = _examples(spark, d), None
    for mode, template in zip(scoring.MODES, _PROMPTS):
        one = scoring.scored(ex, _prompt(template), scoring.HashScorer(), "user_id", "item_id", mode=mode, fallback=0.5)
        one = one.select("user_id", "item_id", F.lit(mode).alias("mode"), F.col("predict").cast("double").alias("p"), "generation")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_EXAMPLES} SELECT user_id, item_id, round({_NEXT}, 6) AS p FROM (SELECT *, {_PROMPTS['qwen']} AS prompt FROM ex)")
def resumed_scores(spark, d):
    """Scores of a run that ended after three chunks and was taken up again: only absent chunks are scored."""
    ex, folder = _examples(spark, d), new_path(spark, "scores")
    run = lambda **most: scoring.score_resumable(ex, _prompt("qwen"), scoring.HashScorer(), folder, "user_id", "item_id", chunk_rows=2_000, **most)
    run(most_chunks=3)
    return run().select("user_id", "item_id", F.col("predict").cast("double").alias("p"))
