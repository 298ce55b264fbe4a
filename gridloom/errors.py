"""Typed errors. ``code`` names the broken rule, so callers can tell failures apart without parsing text."""


class GridError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def require(condition: bool, code: str, message: str) -> None:
    if not condition:
        raise GridError(code, message)
