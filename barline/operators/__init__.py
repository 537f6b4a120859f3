"""Operators over ticks and bars: DataFrame in, DataFrame out."""
