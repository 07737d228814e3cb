"""Whole-table work built from the operators: inference, quality, reports, tasks."""
