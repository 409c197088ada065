"""Training-data operators: ten distributed corpus transformations and their queries.

Nothing else in the library imports this subpackage.
"""
