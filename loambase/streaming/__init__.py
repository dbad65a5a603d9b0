"""Streaming of knowledge-distillation jobs."""
