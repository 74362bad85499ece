"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``registry`` holds the queries and
their SQL for the driver's entry module.
"""
