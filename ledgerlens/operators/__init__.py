"""Analytical operators: DataFrame in, lazy DataFrame out."""
