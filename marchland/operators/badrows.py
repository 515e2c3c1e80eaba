"""Rows that fail to parse, apart with their reason, while the valid ones come out typed.

A schema becomes one anchored pattern for the whole line. Lines that fail pass through incremental prefix patterns
(field 1, fields 1-2, ...); the first prefix that no longer matches names the broken field. All of it stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """``value`` is the pattern of a value; ``blank`` lets the field also be empty or ``?``, plain spaces around ignored (then NULL)."""

    name: str
    value: str
    blank: bool = False
    cast: str = "int"

    @property
    def pattern(self) -> str:
        inner = f"(?:{self.value}| *\\?? *)" if self.blank else self.value
        return f'(?:{inner}|"{inner}")'


def whole(alternatives: str) -> str:
    """A whole number: leading zeros, a zero fraction and plain spaces around it are allowed."""
    return f" *0*(?:{alternatives})(?:\\.0+)? *"


BREAST_CANCER = tuple(
    [Field("c0", " *[0-9]+ *", cast="bigint")]
    + [Field(f"c{i}", whole("10|[1-9]"), blank=i == 6) for i in range(1, 10)]
    + [Field("c10", whole("[12]"))]
)
DERMATOLOGY = tuple(
    [Field(f"c{i}", whole("[01]" if i == 10 else "[0-3]")) for i in range(33)]
    + [Field("c33", whole("100|[1-9][0-9]?"), blank=True), Field("c34", whole("[1-6]"))]
)
SCHEMAS = {"BreastCancer": BREAST_CANCER, "Dermatology": DERMATOLOGY}


def line_pattern(fields: tuple[Field, ...]) -> str:
    return "\\A" + ",".join(f.pattern for f in fields) + "\\z"


def prefix_pattern(fields: tuple[Field, ...], upto: int) -> str:
    return "\\A" + ",".join(f.pattern for f in fields[:upto]) + "(?:,|\\z)"


def first_broken(line: Column, fields: tuple[Field, ...]) -> Column:
    """1-based position of the first field whose prefix pattern fails; one past the last if only the tail is wrong."""
    chain = F.when(~line.rlike(prefix_pattern(fields, 1)), F.lit(1))
    for i in range(2, len(fields) + 1):
        chain = chain.when(~line.rlike(prefix_pattern(fields, i)), F.lit(i))
    return chain.otherwise(F.lit(len(fields) + 1))


def _quoting(line: Column) -> tuple[Column, Column]:
    """(quotes are broken, number of fields), from the pieces between quotes: even pieces lie outside of quotes."""
    pieces = F.split(line, '"', -1)
    last = F.size(pieces) - 1
    outside = F.filter(F.transform(pieces, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["i"] % 2 == 0)

    def wrong(p: Column) -> Column:
        first, final = p["i"] == 0, p["i"] == last
        begins = first | p["x"].startswith(",")
        ends = final | p["x"].endswith(",")
        # at the ends of the line a piece may be empty; inside, an empty piece is a doubled quote of a quoted field
        return F.when(p["x"] == "", F.lit(False)).otherwise(~(begins & ends))

    broken = (last % 2 == 1) | F.exists(outside, wrong)
    commas = F.aggregate(outside, F.lit(0), lambda n, p: n + F.length(p["x"]) - F.length(F.replace(p["x"], F.lit(","), F.lit(""))))
    return broken, commas + 1


def parse_lines(
    lines: DataFrame,
    schemas: dict[str, tuple[Field, ...]] = SCHEMAS,
    line_col: str = "line_text",
    name_col: str = "file_name",
) -> DataFrame:
    """Adds ``_kind, _ok, _reason, _broken_field, _n_fields, _fields`` to every row; no row is dropped.

    ``_reason``: NULL for valid lines, else ``null_line``, ``unknown_kind`` (no schema for the file-name prefix), ``blank``,
    ``broken_quotes``, ``field_count`` or ``invalid_value``. ``_broken_field`` is the name of the first field that fails, or
    ``end_of_line``. ``_fields`` holds the unquoted texts of a valid line. One trailing carriage return is no part of a line.
    Existing columns keep their values; input columns must not start with an underscore like the ones added.
    """
    text = F.col(line_col)
    line = F.when(text.endswith("\r"), F.expr(f"substring(`{line_col}`, 1, length(`{line_col}`) - 1)")).otherwise(text)
    kind = F.lit(None).cast("string")
    for prefix in schemas:
        kind = F.when(F.col(name_col).startswith(prefix), F.lit(prefix)).otherwise(kind)
    df = lines.withColumns({"_kind": kind, "_line": line})

    def per_kind(build, last) -> Column:
        out = last
        for prefix, fields in schemas.items():
            out = F.when(F.col("_kind") == prefix, build(prefix, fields)).otherwise(out)
        return out

    ok = per_kind(lambda _, fields: F.col("_line").rlike(line_pattern(fields)), F.lit(False))
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    broken, n_fields = _quoting(F.col("_line"))
    wanted = per_kind(lambda _, fields: F.lit(len(fields)), F.lit(None).cast("int"))
    reason = (
        F.when(F.col("_ok"), F.lit(None).cast("string"))
        .when(F.col("_line").isNull(), "null_line")
        .when(F.col("_kind").isNull(), "unknown_kind")
        .when(F.trim(F.regexp_replace("_line", "\\s", "")) == "", "blank")
        .when(broken, "broken_quotes")
        .when(n_fields != wanted, "field_count")
        .otherwise("invalid_value")
    )

    def field_name(prefix: str, fields: tuple[Field, ...]) -> Column:
        names = F.array(*[F.lit(f.name) for f in fields], F.lit("end_of_line"))
        return F.element_at(names, first_broken(F.col("_line"), fields))

    where = F.when(~F.col("_ok") & F.col("_line").isNotNull(), per_kind(field_name, F.lit(None).cast("string")))
    # values of valid lines hold neither commas nor inner quotes, so a plain split is exact there
    parts = F.when(F.col("_ok"), F.transform(F.split("_line", ",", -1), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))))
    return df.withColumns({"_reason": reason, "_broken_field": where, "_n_fields": F.when(F.col("_line").isNotNull(), n_fields), "_fields": parts}).drop("_line")


def bad_lines(lines: DataFrame, **options) -> DataFrame:
    """Lines that don't parse: the input's columns and kind, reason, broken_field, n_fields."""
    out = parse_lines(lines, **options).where(~F.col("_ok"))
    keep = [F.col(c) for c in lines.columns]
    return out.select(*keep, F.col("_kind").alias("kind"), F.col("_reason").alias("reason"), F.col("_broken_field").alias("broken_field"), F.col("_n_fields").alias("n_fields"))


def typed_rows(lines: DataFrame, kind: str, key: str = "line_id", schemas: dict[str, tuple[Field, ...]] = SCHEMAS, **options) -> DataFrame:
    """The valid lines of one kind as typed columns beside their key; empty and ``?`` fields become NULL."""
    out = parse_lines(lines, schemas=schemas, **options).where(F.col("_ok") & (F.col("_kind") == kind))

    def typed(i: int, f: Field) -> Column:
        text = F.regexp_replace(F.element_at("_fields", i + 1), "\\.0+$", "")
        return text.try_cast(f.cast).alias(f.name)

    return out.select(key, *[typed(i, f) for i, f in enumerate(schemas[kind])])
