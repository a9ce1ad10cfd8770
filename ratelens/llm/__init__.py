"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  One module per operator,
``queries.py`` registers them for the driver, ``shared.py`` holds the helpers.
"""
