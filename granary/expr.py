"""A builder of expressions: ``T.total > 5`` is the plain list ``['$gt', 'total', 5]``, so plans are data."""

from __future__ import annotations

from typing import Any


def plain(x: Any) -> Any:
    """The list form of anything an expression may hold."""
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


class Expr:
    """An expression; operators and methods build larger ones. ``x.name(args)`` is the operator ``$name``."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, node: Any):
        self.node = node

    def _op(self, name: str, *args: Any) -> Expr:
        return Expr([f"${name}", self.node, *map(plain, args)])

    def in_(self, values: Any) -> Expr:
        """Membership in a list of integers or in the keys of a table (``ref``)."""
        return self._op("in", values)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args: self._op(name.rstrip("_"), *args)

    def __repr__(self) -> str:
        return f"Expr({self.node!r})"

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ to combine expressions")


def _binary(name: str, swapped: bool = False):
    def op(self: Expr, other: Any) -> Expr:
        return Expr([f"${name}", plain(other), self.node]) if swapped else self._op(name, other)

    return op


for _method, _name in {
    "lt": "lt", "le": "lte", "gt": "gt", "ge": "gte", "eq": "eq", "ne": "ne", "and": "and", "or": "or", "xor": "xor", "add": "add", "sub": "sub",
    "mul": "mul", "truediv": "div", "floordiv": "div", "mod": "mod", "pow": "pow", "lshift": "shl", "rshift": "shr",
}.items():
    setattr(Expr, f"__{_method}__", _binary(_name))
    if _method not in ("lt", "le", "gt", "ge", "eq", "ne"):
        setattr(Expr, f"__r{_method}__", _binary(_name, swapped=True))
Expr.__invert__ = lambda self: self._op("not")
Expr.__neg__ = lambda self: self._op("neg")


class _Fields:
    """``T.name`` is the field ``name``."""

    def __getattr__(self, name: str) -> Expr:
        return Expr(name)

    def __getitem__(self, name: str) -> Expr:
        return Expr(name)


T = _Fields()


def ref(bucket: str, table: int) -> str:
    """A table named inside an expression."""
    return f"{bucket}[{table}]"
