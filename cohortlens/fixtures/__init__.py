"""Bindings of the operators to the supplied tables, and their SQL counterparts."""
