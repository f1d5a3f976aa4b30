"""A table of queries and their SQL, filled by a decorator."""

from collections.abc import Callable


class Registry:
    """queries and oracles by name; used as a decorator, it registers a function under its name, with its SQL if there is any."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put
