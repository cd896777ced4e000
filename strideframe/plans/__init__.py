"""Whole runs composed of the operators: preparation, parameter search, studies and reports."""
