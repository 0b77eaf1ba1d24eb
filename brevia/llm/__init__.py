"""Operations of a training-data pipeline, each usable on any DataFrame with the named columns.

Nothing else in the package imports this one.
"""
