"""Operators of a training-data pipeline: token output, token counts, near-duplicates,
personal data, language-model scores, mixing, quality rules, pieces and chat formatting.

Nothing outside this package imports it."""
