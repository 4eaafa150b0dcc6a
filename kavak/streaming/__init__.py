"""The study log as a stream."""
