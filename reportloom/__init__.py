"""reportloom: a PySpark engine for corpora of company reports.

Every operator is a function from DataFrames to a DataFrame; nothing runs until
the caller asks for rows, except where a docstring says that an operator loops.
"""

__version__ = "0.1.0"
