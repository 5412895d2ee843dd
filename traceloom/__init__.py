"""Agent-session analytics on Spark: ``engine`` has the commands, the subpackages their parts."""

__all__ = ["distill", "list_sessions", "parse_sessions", "preview"]


def __getattr__(name: str):
    # workers of other subpackages import this one; they need none of the commands
    if name in __all__:
        from . import engine

        return getattr(engine, name)
    raise AttributeError(name)
