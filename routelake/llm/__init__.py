"""Operators for large-scale training-data pipelines (URL filters, near-dedup, licences, token counts,
language ID, token storage, byte-level BPE, LM scoring, exact search, decontamination).

Nothing else in the library imports this subpackage; its registered queries are in ``queries.py``.
"""
