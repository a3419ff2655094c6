"""Relational, vector, lexical, statistical and compositional operators."""
