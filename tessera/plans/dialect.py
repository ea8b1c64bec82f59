"""One declarative text per plan, spelled for Spark SQL or for the SQL oracle.

The engines differ in a few spellings only (arrays, regular-expression literals,
lateral joins). A plan is a function of a Dialect that returns SQL; Spark runs
it through Catalyst, and the oracle runs the same relational definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def t(self, name: str) -> str:
        return f"tessera_{name}" if self.spark else name

    def re(self, pattern: str) -> str:
        """A regular expression as a literal."""
        return ("r" if self.spark else "") + f"'{pattern}'"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        """The first match, empty if none or null."""
        return f"coalesce(regexp_extract({x}, {self.re(pattern)}, {group}), '')"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.re(pattern)})" if self.spark else f"regexp_matches({x}, {self.re(pattern)})"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, '{to}')" if self.spark else f"regexp_replace({x}, {self.re(pattern)}, '{to}', 'g')"

    def each(self, array: str, alias: str) -> str:
        return f"LATERAL explode({array}) AS {alias}" if self.spark else f"UNNEST({array}) AS {alias}"

    def each_at(self, array: str, at: str, value: str) -> str:
        """Elements with their place from 0."""
        if self.spark:
            return f"LATERAL posexplode({array}) AS pos({at}, {value})"
        return f"(SELECT unnest(range(len({array}))) AS {at}, unnest({array}) AS {value}) AS pos"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.re(by)})" if self.spark else f"regexp_split_to_array({x}, {self.re(by)})"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), cast(0 AS double), (s, v) -> s + v)"
        return f"list_inner_product(cast({a} AS double[]), cast({b} AS double[]))"

    def listed(self, value: str, order: str) -> str:
        """Values collected in an order."""
        if self.spark:
            return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)"
        return f"list({value} ORDER BY {order})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {by})" if self.spark else f"array_to_string({array}, {by})"

    @property
    def string(self) -> str:
        return "string" if self.spark else "varchar"


SPARK, ORACLE = Dialect(True), Dialect(False)


def tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\btessera_([a-z]+)\b", sql)))
