"""Operations of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage. ``catalog`` registers
one query per operator.
"""
