"""Live recording as Structured Streaming, and the control of many tasks."""
