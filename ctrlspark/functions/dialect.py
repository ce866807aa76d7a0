"""Spelling of SQL expressions for Spark and for the SQL engine that checks it."""

from __future__ import annotations

from collections.abc import Sequence


class Dialect:
    """Text of common expressions in one engine's SQL.  Patterns hold no single or double quotes."""

    def __init__(self, spark: bool):
        self.spark = spark

    def pattern(self, text: str) -> str:
        return f'r"{text}"' if self.spark else f"'{text}'"

    def rx(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.pattern(pattern)})" if self.spark else f"regexp_matches({x}, {self.pattern(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(pattern)}, {group})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        """``by`` names groups as {1}, {2}."""
        for k in (1, 2):
            by = by.replace(f"{{{k}}}", f"${k}" if self.spark else f"\\{k}")
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.pattern(by)}" + (")" if self.spark else ", 'g')")

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.pattern(pattern)})" if self.spark else f"string_split_regex({x}, {self.pattern(pattern)})"

    def array(self, items: Sequence[str]) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def strings(self, items: Sequence[str]) -> str:
        return self.array([f"'{i}'" for i in items])

    def _lambda(self, var: str, body: str) -> str:
        return f"{var} -> {body}" if self.spark else f"lambda {var}: {body}"

    def transform(self, xs: str, var: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({xs}, {self._lambda(var, body)})"

    def filter(self, xs: str, var: str, body: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({xs}, {self._lambda(var, body)})"

    def join(self, xs: str, sep: str) -> str:
        return f"{'array_join' if self.spark else 'array_to_string'}({xs}, '{sep}')"

    def sort(self, xs: str) -> str:
        return f"{'array_sort' if self.spark else 'list_sort'}({xs})"

    def distinct(self, xs: str) -> str:
        return f"{'array_distinct' if self.spark else 'list_distinct'}({xs})"

    def has(self, xs: str, x: str) -> str:
        return f"{'array_contains' if self.spark else 'list_contains'}({xs}, {x})"

    def overlap(self, xs: str, ys: str) -> str:
        return f"{'arrays_overlap' if self.spark else 'list_has_any'}({xs}, {ys})"

    def size(self, xs: str) -> str:
        return f"{'size' if self.spark else 'len'}({xs})"

    def item(self, xs: str, k: int) -> str:
        return f"try_element_at({xs}, {k})" if self.spark else f"list_extract({xs}, {k})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def concat_ws(self, sep: str, *xs: str) -> str:
        return f"concat_ws({sep}, {', '.join(xs)})"


SPARK, DUCK = Dialect(True), Dialect(False)
