"""The three reports, each a set of named result tables."""
