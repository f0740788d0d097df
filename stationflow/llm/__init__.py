"""Operators for text records: preparing provider exports as training data.

The record is the *source record*: one raw text that a provider published (a trip line, a snapshot
document, a station-status page), with its `source_record_id` and its `raw_text`. Other columns may
be present and are ignored. Ids may be null or repeated; a null text counts as empty.
"""
