"""Spark-first analytics for long documents: text, planning, cost, glossary, layout and state operators."""
