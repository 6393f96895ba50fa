"""Training-data operators: dedup, filters, classifiers, tokenisation and materialisation.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
