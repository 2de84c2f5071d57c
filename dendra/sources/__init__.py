"""Inputs and outputs: vectors, graphs, generators, exports."""
