"""lexilake: a research-library analytics engine written for Spark.

Sub-packages: ``sources`` (tables and archives), ``functions`` (column
functions), ``operators`` (DataFrame to DataFrame), ``streaming`` (stateful and
time-driven operators), ``plans`` (the registered queries and their oracle SQL).
"""
