"""Effect models and tabular profiling on Spark DataFrames.

``sources``   reading, writing and describing tables
``functions`` column expressions
``operators`` DataFrame in, DataFrame out
``plans``     multi-step studies built from the operators
"""
