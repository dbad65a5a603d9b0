"""Knowledge-distillation jobs on Spark."""
