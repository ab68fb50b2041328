"""Runnable jobs: each module has a function that takes a session and paths, and a command line."""
