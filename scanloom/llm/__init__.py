"""Operators of a training-data pipeline: near-duplicates, line dedup, packing, chat formatting,
token files, fingerprints, quality, language, BPE and nearest neighbours.

Nothing else in the library imports this subpackage, but for the code shipping in ``common``.
"""
