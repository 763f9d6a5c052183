"""Stages and their parts: DataFrame in, DataFrame out."""
