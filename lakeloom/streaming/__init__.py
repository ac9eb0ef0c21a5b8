"""Beyond parity: the event table as a stream."""

from lakeloom.streaming.events import event_windows, read_event_stream, run_once

__all__ = ["event_windows", "read_event_stream", "run_once"]
