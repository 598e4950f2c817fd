"""Operators: functions from DataFrame to DataFrame, for use with ``df.transform``."""
