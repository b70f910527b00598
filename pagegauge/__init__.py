"""Transcription-quality scoring as Spark jobs.

Ground-truth pages and model predictions are DataFrames; every metric is a
column expression or a DataFrame operator over a table of pairs
(model, doc, page), and every report is an aggregation over the page scores.
"""
