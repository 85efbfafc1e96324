"""Evaluation of constant expressions of analysed programs, over Python's own grammar."""

from __future__ import annotations

import ast
import operator

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.LShift: operator.lshift, ast.RShift: operator.rshift,
}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
BOTTOM, TOP = ("bottom", None), ("top", None)
_WORDS = {"true": "True", "false": "False", "null": "None", "&&": " and ", "||": " or "}


class _Unknown(Exception):
    pass


def _value(node: ast.AST, env: dict):
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, str, bool)):
        return node.value
    if isinstance(node, ast.Name):
        tag, value = env.get(node.id, TOP)
        if tag != "const":
            raise _Unknown
        return value
    if isinstance(node, ast.UnaryOp):
        x = _value(node.operand, env)
        if isinstance(node.op, ast.Not):
            return not x
        if not isinstance(x, int):
            raise _Unknown
        return {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Invert: operator.invert}[type(node.op)](x)
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left, env), _value(node.right, env)
        if isinstance(node.op, ast.Div):
            return a // b if isinstance(a, int) and isinstance(b, int) else _fail()
        if isinstance(a, str) != isinstance(b, str) or isinstance(a, str) and not isinstance(node.op, ast.Add):
            raise _Unknown
        if isinstance(node.op, (ast.LShift, ast.RShift)) and not 0 <= b < 64:
            raise _Unknown
        return _BINARY[type(node.op)](a, b)
    if isinstance(node, ast.BoolOp):
        stop = isinstance(node.op, ast.Or)
        for part in node.values:
            x = _value(part, env)
            if bool(x) == stop:
                return x
        return x
    if isinstance(node, ast.Compare):
        left = _value(node.left, env)
        for op, right in zip(node.ops, node.comparators, strict=True):
            right = _value(right, env)
            if type(op) not in _COMPARE or isinstance(left, str) != isinstance(right, str) or not _COMPARE[type(op)](left, right):
                if type(op) not in _COMPARE:
                    raise _Unknown
                return False
            left = right
        return True
    if isinstance(node, ast.IfExp):
        return _value(node.body if _value(node.test, env) else node.orelse, env)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "len" and len(node.args) == 1:
        x = _value(node.args[0], env)
        return len(x) if isinstance(x, str) else _fail()
    raise _Unknown


def _fail():
    raise _Unknown


def evaluate(expression: str | None, env: dict) -> tuple[str, object]:
    """``('const', value)`` or bottom; ``env`` maps names to such pairs."""
    text = (expression or "").strip().rstrip(";")
    for a, b in _WORDS.items():
        text = text.replace(a, b)
    try:
        return "const", _value(ast.parse(text, mode="eval").body, env)
    except (_Unknown, SyntaxError, ZeroDivisionError, KeyError, ValueError, TypeError, RecursionError, MemoryError):
        return BOTTOM
