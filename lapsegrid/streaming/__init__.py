"""Structured Streaming forms of the operators that observations arriving over time need."""
