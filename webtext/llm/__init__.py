"""Operations of a training-data pipeline over the corpus tables.

Nothing else in the library imports this subpackage.
"""
