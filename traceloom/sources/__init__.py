"""Adapters from logs and tables to sessions, messages and tool calls."""
