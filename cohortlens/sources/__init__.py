"""Inputs and outputs: labelled sources, parts, inline dimensions, table sinks."""
