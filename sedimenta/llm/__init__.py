"""Operators for large training-data pipelines.

Nothing outside this folder imports it. Each operator has a module with its
own general interface; ``queries`` registers the production queries and
``oracles`` the SQL that checks them.
"""
