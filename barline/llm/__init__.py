"""Training-data operators over document tables.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface plus the thin ``query`` that applies it to the whole ``documents`` table.
"""
