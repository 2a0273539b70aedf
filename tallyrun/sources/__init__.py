"""Reading events from files, a durable log of pushed events, and demo generators."""

from .files import read_events, stream_events
from .log import EventLog

__all__ = ["EventLog", "read_events", "stream_events"]
