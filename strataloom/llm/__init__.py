"""Operators for preparing training data at scale.

Everything here is optional: nothing outside this subpackage imports it.
"""
