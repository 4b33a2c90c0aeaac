"""Grouped component tables in Spark: density, diversity, dissonance, classification and the relational layer around them."""
