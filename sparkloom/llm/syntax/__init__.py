"""Grammars, the tables made from them, and the lexers that feed them."""
