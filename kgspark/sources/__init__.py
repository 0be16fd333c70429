"""Readers and writers: graph tables and stores, Turtle, articles and abstracts, runs."""
