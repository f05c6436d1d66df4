"""Operators of a training-data pipeline: language, quality, duplicates,
decontamination, extraction, tokens, packing, search. Nothing else in the
library imports this subpackage."""
