"""Operators for preparing language-model training data.

One module per operator.  ``registry`` lists the queries built on them; nothing
outside this subpackage imports it.
"""
