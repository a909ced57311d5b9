"""Runnable jobs over the given tables. Each has a function that takes a session, a command line and a config file."""
