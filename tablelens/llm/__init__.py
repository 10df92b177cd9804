"""Training-data operators: dedup, packing, filters, scoring and token output.

Nothing else in the library imports this subpackage. ``queries.py`` registers
one ``opN_<name>`` query per operator; ``corpus_pipeline.py`` at the repository
top chains five of them.
"""
