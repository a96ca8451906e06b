"""Training-data operators: packing, token counts, quality, privacy, toxicity,
byte-level BPE, fingerprints, HTML extraction and near-duplicate detection.

Nothing outside this subpackage imports it.
"""
