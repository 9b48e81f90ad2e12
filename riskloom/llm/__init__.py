"""Training-data operators: tokens, near duplicates, filters, extraction, search.

Nothing else in the library imports this package. Each module holds one
operator as ``DataFrame -> DataFrame`` functions; ``registry`` binds the thin
``opN_<name>`` queries over the driver tables.
"""
