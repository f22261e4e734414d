"""Registered queries: each is a function of a session and a data folder, most with a SQL twin."""
