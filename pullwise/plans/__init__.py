"""Whole pipelines: layers to scorecards, export directories to exports, audit log to reports."""
