"""Operators of knowledge-distillation jobs."""
