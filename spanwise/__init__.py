"""Spell algebra, ledgers, person-by-period assembly and tabulation on Spark DataFrames."""
