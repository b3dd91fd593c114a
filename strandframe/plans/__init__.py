"""Registered queries: fixtures over the driver's tables, a Spark plan and its SQL for each operator."""
