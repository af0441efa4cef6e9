"""Feedback analytics as Spark DataFrames: prepare reviews, find themes, answer questions."""
