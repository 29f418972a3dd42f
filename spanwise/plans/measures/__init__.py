"""Measure definitions: raw agency tables to tidy spells and events.

Every function takes DataFrames with the column names of the source tables and
returns a lazy DataFrame. Dates of the study window are parameters.
"""
