"""quillon: validation and analysis of workload traces and labelled text on Spark.

Expressions are functions that return Columns, operators are functions from
DataFrames to DataFrames; nothing is collected but results of a fixed size.
"""
