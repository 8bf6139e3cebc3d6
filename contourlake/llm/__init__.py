"""Training-data operators: filters, classifiers, near-duplicates, packing and token output.

Nothing outside this subpackage imports it.
"""
