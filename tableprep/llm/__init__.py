"""Operators for preparing the text a language model is trained on. Nothing else in the library imports them."""
