"""Parameters of generalizers, and the SQL templates that they are put into."""

from __future__ import annotations

from string import Formatter

from .tags import check_identifier

Value = None | str | int | float | bool


def shown(value: Value) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


class Params:
    """Named values of five kinds, read with the kind that is wanted."""

    def __init__(self, **values: Value) -> None:
        self.values = dict(values)

    def has(self, key: str) -> bool:
        return key in self.values

    def set(self, key: str, value: Value) -> None:
        self.values[key] = value

    def _typed(self, key: str, kind: type, default):
        if key not in self.values:
            return default
        value = self.values[key]
        if type(value) is not kind:
            raise ValueError(f"invalid value {shown(value)!r} for {key}")
        return value

    def get_bool(self, key: str, default: bool = False) -> bool:
        return self._typed(key, bool, default)

    def get_int(self, key: str, default: int = 0) -> int:
        return self._typed(key, int, default)

    def get_double(self, key: str, default: float = 0.0) -> float:
        return float(self.values[key]) if type(self.values.get(key)) is int else self._typed(key, float, default)

    def get_string(self, key: str, default: str | None = None) -> str:
        if key not in self.values and default is None:
            raise ValueError(f"missing parameter {key!r}")
        return shown(self.values[key]) if default is None else self._typed(key, str, default)

    def get_identifier(self, key: str) -> str:
        return check_identifier(shown(self.values[key])) if key in self.values else ""


def render(template: str, params: Params | None = None, **more: Value) -> str:
    """The template with each ``{name}`` replaced; doubled braces stand for themselves; a name without a value is an error."""
    values = {**(params.values if params else {}), **more}
    out = []
    for text, name, form, conversion in Formatter().parse(template):
        out.append(text)
        if name is None:
            continue
        if name not in values or form or conversion:
            raise ValueError(f"missing parameter {name!r} for the template {template!r}")
        out.append(shown(values[name]))
    return "".join(out)
