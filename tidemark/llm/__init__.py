"""Operators for training-data pipelines, one module each.

``shards`` (1), ``bpe`` (2), ``html`` (3), ``packing`` (4), ``toxicity`` (5),
``quality`` (6), ``fingerprints`` (7), ``licenses`` (8), ``neardup`` (9) and
``topk`` (10).  ``queries`` registers them.  Nothing else in the library
imports this subpackage.
"""
