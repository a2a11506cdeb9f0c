"""List columns: decoding text, splitting, padding, one-hot coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the padding sentinel of dense exports.
PADDING = -999


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_list(c: Column | str, elem: str = "double") -> Column:
    """Text such as '[1, 2.5, nan]' to an array; bare nan and None are read as NaN and NULL."""
    text = _col(c)
    if "double" in elem or "float" in elem:
        text = F.regexp_replace(text, r"(?i)\bnan\b", "NaN")
    text = F.regexp_replace(text, r"\bNone\b", "null")
    return F.from_json(text, f"array<{elem}>")


def decode_brackets(c: Column | str, elem: str = "double") -> Column:
    """Strip brackets and blanks, split on commas, cast."""
    parts = F.split(F.translate(_col(c), "[] ", ""), ",")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast(elem))


def decode_braces(c: Column | str) -> Column:
    """Text such as "['{1, 2}', '{3}']" to a list of lists."""
    bare = F.translate(_col(c), "'\"", "")
    return F.from_json(F.translate(bare, "{}", "[]"), "array<array<double>>")


def split_list(c: Column | str, elem: str = "string", sep: str = ";") -> Column:
    """'a;b;;c' to an array, blanks dropped; NULL stays NULL."""
    parts = F.filter(F.split(_col(c), sep), lambda x: x != "")
    return parts if elem == "string" else F.transform(parts, lambda x: x.cast(elem))


def join_list(c: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.transform(_col(c), lambda x: x.cast("string")), sep)


def explode_parallel(df: DataFrame, lists: list[str], pos: str = "pos") -> DataFrame:
    """Explode equally long list columns together; a NULL list gives NULLs, not lost rows."""
    length = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in lists])
    types = dict(df.dtypes)
    filled = [
        F.coalesce(F.col(c), F.array_repeat(F.lit(None).cast(types[c][6:-1]), length)).alias(c) for c in lists
    ]
    rest = [c for c in df.columns if c not in lists]
    items = df.select(*rest, F.posexplode(F.arrays_zip(*filled)).alias(pos, "_item"))
    return items.select(*rest, pos, *[F.col("_item")[c].alias(c) for c in lists])


def null_if_all_null_single(c: Column | str) -> Column:
    """A one-element list holding NULL becomes NULL."""
    lst = _col(c)
    return F.when((F.size(lst) == 1) & F.get(lst, F.lit(0)).isNull(), None).otherwise(lst)


def wrap(c: Column | str) -> Column:
    """Scalar to one-element list, NULL to the empty list."""
    value = _col(c)
    one = F.array(value)
    return F.when(value.isNull(), F.slice(one, 1, 0)).otherwise(one)


def pad(c: Column | str, length: int, fill=PADDING) -> Column:
    """Append ``fill`` (a value or a column) up to ``length``, never truncating; NULL
    becomes all padding."""
    lst, value = _col(c), fill if isinstance(fill, Column) else F.lit(fill)
    missing = F.greatest(F.lit(length) - F.size(lst), F.lit(0))
    return F.coalesce(F.concat(lst, F.array_repeat(value, missing)), F.array_repeat(value, F.lit(length)))


def pad_nested(c: Column | str, length: int, inner: int, fill=PADDING) -> Column:
    """Pad the inner lists to ``inner`` and the outer list to ``length``; NULL becomes all padding."""
    rows = F.transform(_col(c), lambda x: pad(x, inner, fill))
    empty = F.array_repeat(F.lit(fill), F.lit(inner))
    missing = F.greatest(F.lit(length) - F.size(_col(c)), F.lit(0))
    return F.coalesce(F.concat(rows, F.array_repeat(empty, missing)), F.array_repeat(empty, F.lit(length)))


def fit(c: Column | str, k: int, fill=0.0) -> Column:
    """Exactly ``k`` entries: truncated or filled."""
    return pad(F.slice(_col(c), 1, k), k, fill)


def one_hot(value: Column | str, choices: list) -> Column:
    """len(choices) + 1 flags; the last one marks an unknown value."""
    col = _col(value)
    known = col.isin(choices)
    flags = [F.coalesce(col == F.lit(c), F.lit(False)).cast("int") for c in choices]
    return F.array(*flags, (~F.coalesce(known, F.lit(False))).cast("int"))


def one_hot_row(attributes: dict[str, list]) -> Column:
    """Concatenated one-hot blocks, one per attribute, in the given order."""
    return F.concat(*[one_hot(name, choices) for name, choices in attributes.items()])


def map_elements(c: Column | str, mapping: dict) -> Column:
    """Replace every list element by a small literal mapping; unknown elements give NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.transform(_col(c), lambda x: F.try_element_at(F.create_map(*pairs), x))


def all_in(c: Column | str, members: list) -> Column:
    return F.forall(_col(c), lambda x: x.isin(members))


def any_in(c: Column | str, members: list) -> Column:
    return F.exists(_col(c), lambda x: x.isin(members))


def is_padding(c: Column | str, fill=PADDING) -> Column:
    """Every entry equals the sentinel."""
    return F.forall(_col(c), lambda x: x == fill)
