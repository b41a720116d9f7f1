"""Structured Streaming: maintained views, retractable aggregates, lifetimes."""
