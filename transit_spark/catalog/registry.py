"""Query registration."""

from __future__ import annotations


class Registry:
    """Queries of one module and their SQL twins."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, oracle: str | None = None):
        def register(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return register
