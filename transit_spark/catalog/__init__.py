"""Registered queries over the supplied tables, each with an independent SQL twin where SQL can say it."""
