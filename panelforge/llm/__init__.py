"""Operators that prepare text corpora for training: cleaning, deduplication, decontamination, tokens, archives.

Each takes DataFrames and returns a DataFrame. They select the columns they name and pass no others on, unless they say
so, so extra columns can't clash with theirs. A null text counts as an empty one.
"""
