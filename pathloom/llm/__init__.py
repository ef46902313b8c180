"""Operators for preparing training corpora: filtering, dedup, scoring, mixing, packing, search.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`pathloom.llm.queries` derives the
registered queries from them.
"""
