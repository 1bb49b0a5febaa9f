"""Training-data operators: dedup, language ID, quality, LM scoring, extraction,
fingerprints, decontamination, packing and chat formatting.

Nothing outside this subpackage imports it.
"""
