"""Execution of record operations and the tools that expose everything."""
