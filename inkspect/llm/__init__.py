"""Training-data operators: packing, tokenising, language ID, dedup, quality, media.

Nothing outside this subpackage imports it.  Every operator reads only the
columns it needs (``doc_id`` and ``text``), so extra or clashing columns of the
input never matter, and an empty table gives an empty result.
"""
