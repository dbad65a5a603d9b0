"""Functions of knowledge-distillation jobs."""
