"""Runnable jobs: each module has a command line, a small configuration and a function that takes a session."""
