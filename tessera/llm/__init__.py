"""Operations of a training-data pipeline: ten operators and their driver queries.

Nothing outside this folder imports it.  Each module holds one operator with its own
general interface and a thin ``opN_<name>(spark, sf_dir)`` query.
"""
