"""The scalar functions that expressions may call: an allow-list over Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: Names that are the same here and in ``pyspark.sql.functions``; all stay in the JVM.
_SAME = """
lower upper length trim ltrim rtrim abs round ceil floor sqrt exp pow coalesce nullif greatest least
substring replace split concat concat_ws lpad rpad reverse initcap instr translate
regexp_extract regexp_replace regexp_count startswith endswith contains
year month dayofmonth dayofweek hour minute second date_trunc date_add date_diff add_months last_day to_date
sha2 md5 xxhash64 crc32 size array_contains array_distinct sort_array element_at explode flatten
get_json_object to_json from_json map_keys map_values isnan nanvl sign log log10 pmod try_divide
""".split()
_OTHER = {"absolute": "abs", "mean": "avg", "ln": "log", "day": "dayofmonth", "is_null": "isnull", "is_not_null": "isnotnull"}
#: Positions of arguments that these take as plain values, not as columns.
PLAIN = {
    "round": {1}, "concat_ws": {0}, "regexp_extract": {1, 2}, "date_trunc": {0}, "sha2": {1}, "get_json_object": {1},
    "from_json": {1}, "translate": {1, 2}, "instr": {1}, "lpad": {1}, "rpad": {1}, "split": {1},
}
_REGISTERED: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    """Add a function of columns under ``name`` (for instance a pandas UDF)."""
    _REGISTERED[name.lower()] = function


def lookup(name: str) -> Callable:
    """The function of a name; an unknown one raises, whatever Spark would make of it."""
    low = name.lower()
    if low in _REGISTERED:
        return _REGISTERED[low]
    if low == "if":
        return lambda test, yes, no: F.when(test, yes).otherwise(no)
    low = _OTHER.get(low, low)
    if low in _SAME or low in _OTHER.values():
        return getattr(F, low)
    raise ValueError(f"unknown function {name!r}")
