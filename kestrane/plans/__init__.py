"""The query language: parser and planner."""
