"""Relational operators: windows, aggregates, mergeable state, running windows, retention, in-flight text."""
