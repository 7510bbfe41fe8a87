"""The evaluator for single documents, whose shapes are known only at run time."""
