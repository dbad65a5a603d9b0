"""Sources of knowledge-distillation jobs."""
