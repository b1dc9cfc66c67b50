"""Checks of a survey while it is flown, with Structured Streaming."""

from .gaps import watch

__all__ = ["watch"]
