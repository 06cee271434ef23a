"""Arithmetic expressions in text, compiled to columns so that codegen runs them."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def _safe_log(v: Column) -> Column:
    return F.ln(F.greatest(F.abs(v), F.lit(1e-12)))


FUNCTIONS = {
    "exp": lambda v: F.exp(F.least(F.greatest(v, F.lit(-50.0)), F.lit(50.0))), "log": _safe_log, "log10": lambda v: _safe_log(v) / F.ln(F.lit(10.0)),
    "sqrt": lambda v: F.sqrt(F.abs(v)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "abs": F.abs,
}


ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


def compile_expression(text: str, variables: dict[str, Column]) -> Column:
    """``+ - * / ^``, the functions above, numbers and the given names; anything else is an error.  Division by nearly nothing gives 1."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in variables:
            return variables[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            v = build(node.operand)
            return -v if isinstance(node.op, ast.USub) else v
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return F.when(F.abs(b) > 1e-12, a / F.nullif(b, F.lit(0.0))).otherwise(1.0)
            if isinstance(node.op, ast.Pow):
                return F.pow(a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1 and not node.keywords:
            return FUNCTIONS[node.func.id](build(node.args[0]))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    return build(ast.parse(text.replace("^", "**"), mode="eval"))


def simplified(text: str) -> str:
    """Constants folded, neutral elements dropped."""

    class Fold(ast.NodeTransformer):
        def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
            self.generic_visit(node)
            a, b = node.left, node.right
            number = lambda x: x.value if isinstance(x, ast.Constant) else None
            if number(a) is not None and number(b) is not None and type(node.op) in ARITHMETIC and not (isinstance(node.op, ast.Div) and number(b) == 0):
                return ast.Constant(ARITHMETIC[type(node.op)](number(a), number(b)))
            if isinstance(node.op, ast.Add):
                return b if number(a) == 0 else a if number(b) == 0 else node
            if isinstance(node.op, ast.Mult):
                return ast.Constant(0) if 0 in (number(a), number(b)) else b if number(a) == 1 else a if number(b) == 1 else node
            if isinstance(node.op, (ast.Sub, ast.Div)) and number(b) == (0 if isinstance(node.op, ast.Sub) else 1):
                return a
            return node

    tree = Fold().visit(ast.parse(text.replace("^", "**"), mode="eval"))
    return ast.unparse(ast.fix_missing_locations(tree)).replace("**", "^")
