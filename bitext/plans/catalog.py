"""Import every plan module so that all queries are registered."""

from . import corpus, encoding, generate, runlog, scoring, strategies, translation, stream  # noqa: F401
