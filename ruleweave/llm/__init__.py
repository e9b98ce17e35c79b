"""Operators of a training-data pipeline: filters, dedup, decontamination, packing, scoring."""
