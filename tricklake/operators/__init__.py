"""Operators: functions DataFrame -> DataFrame, one module a subject."""
