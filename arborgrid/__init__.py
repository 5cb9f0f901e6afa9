"""arborgrid: pixel, sample and graph analytics expressed with Spark DataFrames.

Sub-packages
------------
functions  pure Column libraries (colour, distances, strings, paths, arithmetic, boxes)
operators  relational operators (aggregates, joins, sets, grids, graphs, learning, filling)
sources    readers and writers
plans      helpers about physical behaviour (cutting lineage, skew-safe ranking, size checks)
streaming  stateful recomputation on Structured Streaming
llm        training-data operators; nothing outside the folder imports it
"""
