"""Stridewell: episodic, step-ordered analytics on Spark DataFrames."""
