"""Structured Streaming jobs."""

from .append import append_progress, append_stream
from .incremental import incremental_translate
from .runlog import early_stop_stream, run_verdicts

__all__ = ["append_progress", "append_stream", "early_stop_stream", "incremental_translate", "run_verdicts"]
