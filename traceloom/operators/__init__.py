"""DataFrame operators over sessions, messages and tool calls."""
