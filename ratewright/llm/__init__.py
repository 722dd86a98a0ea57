"""Operators of a training-data pipeline: token counts, mixing, quality, language models,
decontamination, similarity joins, personal data, languages, revisits and secrets.

Nothing outside this folder imports it. `ratewright.llm.registry` lists the queries.
"""
