"""Streams of the event log and of growing session logs; an extension of the batch operators."""

from .events import event_counts, read_events, read_lines, session_activity, write_stream

__all__ = ["event_counts", "read_events", "read_lines", "session_activity", "write_stream"]
