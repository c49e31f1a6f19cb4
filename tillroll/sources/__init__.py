"""Inputs and outputs: driver tables and domain views, report reading and parsing, sinks."""
