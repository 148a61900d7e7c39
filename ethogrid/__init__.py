"""Behaviour analytics for tracked-object video data, expressed as Spark DataFrames."""
