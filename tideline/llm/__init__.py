"""Training-data operators.

Nothing else in the library imports this subpackage. Each ``opN`` module holds one
operator with its own general interface and the thin ``opN_<name>`` query on top of it;
``registry`` gathers queries and SQL.
"""
