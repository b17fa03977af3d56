"""Operators for training-data pipelines; ``queries`` registers one query per operator."""
