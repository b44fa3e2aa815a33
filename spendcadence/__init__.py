"""spendcadence: recurring-spend analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, is keyed by ``account_id`` or
``user_id`` and never reads the wall clock: ``today`` is always an argument.
"""
