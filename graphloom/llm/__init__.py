"""Operators that prepare text and code for language models; nothing outside imports this."""
