"""Training-data operators: ten corpus operators, their thin queries and SQL.

Nothing else in the library imports this subpackage; deleting the folder leaves
the rest working.
"""
