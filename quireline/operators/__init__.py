"""Operators over DataFrames: markup, layout, comparison, corpus, rules, fixes, reports."""
