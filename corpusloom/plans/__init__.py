"""Registered queries over the input tables, each with its SQL where SQL can say it."""
