"""Whole jobs: raw records in, facts or summaries out.

Each function composes operators and returns DataFrames; where a job's steps
are the same on a stream, the function takes either.
"""
