"""Operators for preparing language-model training corpora.

Nothing else in the package imports this subpackage.  Each module holds one operator with a
general interface; :mod:`leafmill.llm.queries` holds the thin queries derived from them.
"""
