"""Corpus-preparation operators for training data.

Each module is one operator with its own general interface; ``queries``
applies them to the standard tables.  Nothing outside this package imports it.
"""
