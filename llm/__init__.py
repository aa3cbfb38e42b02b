"""Operators of a training-data pipeline: near duplicates, toxicity, mixing, packing, language model, sharding and others.

Each module holds one operator with its general interface; ``queries.py`` holds the thin registered queries.
"""
