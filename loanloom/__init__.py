"""Loan-risk analytics as Spark jobs: feature tables, profiling, scoring, drift."""
