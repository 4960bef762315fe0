"""Wayloom: transit analytics and journey planning on Spark DataFrames."""
