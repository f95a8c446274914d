"""Training-data operators: deduplication, tokenisation, mixing, scoring, formatting.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries.py`` registers one thin
query per operator, ``sql.py`` their SQL twins where SQL can express them.
"""
