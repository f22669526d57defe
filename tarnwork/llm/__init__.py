"""Operators over prompt, label and document text of training corpora.

Nothing outside this subpackage imports it.
"""
