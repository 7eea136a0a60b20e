"""Relational operators of the engine: functions of DataFrames."""
