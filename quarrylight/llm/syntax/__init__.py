"""Syntax checks: lexers, grammars and a generalised parser."""
