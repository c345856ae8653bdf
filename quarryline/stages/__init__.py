"""Stages: functions from named tables to artifacts, each a chain of operators."""
