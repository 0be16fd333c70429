"""Operators on graphs, questions, retrieval and evaluation runs."""
