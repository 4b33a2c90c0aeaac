"""Operators over grouped component tables; DataFrame in, DataFrame out."""
