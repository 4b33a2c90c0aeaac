"""Queries bound to the tables of a folder, and their SQL."""
