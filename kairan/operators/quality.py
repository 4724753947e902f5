"""Validation of rosters and gated publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.functions.text import compact_name, squeezed, text
from kairan.sources.store import stored


def validate(df: DataFrame, low: int, high: int, required: Sequence[str], unique: Sequence[Sequence[str]], fixed: dict[str, str] | None = None, id_col: str = "id") -> DataFrame:
    """Violations: ``rule``, ``key``, ``n``. None means valid.

    Rules: row count in range, ids positive, required fields not blank, fixed values, unique column sets. Row rules are
    counted in one pass; each uniqueness rule groups by its columns.
    """
    bad = {"id_positive": ~F.coalesce(F.col(id_col) > 0, F.lit(False)), **{f"required_{c}": squeezed(F.col(c)) == "" for c in required}, **{f"fixed_{c}": text(F.col(c)) != v for c, v in (fixed or {}).items()}}
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_if(e).alias(k) for k, e in bad.items()))
    rules_ = [F.struct(F.lit("row_count").alias("rule"), F.when(~F.col("_rows").between(low, high), F.col("_rows")).otherwise(-1).alias("n"))]
    rules_ += [F.struct(F.lit(k).alias("rule"), F.when(F.col(k) > 0, F.col(k)).otherwise(-1).alias("n")) for k in bad]
    out = counts.select(F.explode(F.array(*rules_)).alias("r")).select("r.rule", F.lit("").alias("key"), F.col("r.n").alias("n")).filter("n >= 0")
    for cols in unique:
        key = F.concat_ws("|", *(text(F.col(c)) for c in cols))
        twice = df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(twice.select(F.lit("unique_" + "_".join(cols)).alias("rule"), "key", "n"))
    return out


#: What a field's value may be: ``finite`` as a number, ``name`` a string that isn't blank, ``text`` a string, ``texts`` an
#: array of strings. A ``?`` lets it be null or absent.
KINDS = ("finite", "finite?", "name", "text", "text?", "texts", "texts?")
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")


def _fits(v: Column, kind: str) -> Column:
    """Whether a variant (null where the field is absent) is of a kind."""
    said, none = F.schema_of_variant(v), v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
    number = said.isin(*_NUMBERS) | said.startswith("DECIMAL")
    told = F.try_variant_get(v, "$", "string")
    as_number = F.when(F.trim(told) == "", F.lit(0.0)).otherwise(F.trim(told).try_cast("double"))
    finite = F.when(said == "STRING", as_number.isNotNull() & ~F.isnan(as_number) & (F.abs(as_number) < float("inf"))).otherwise(number)
    each = F.try_variant_get(v, "$", "array<variant>")
    fits = {
        "finite": finite,
        "name": (said == "STRING") & (squeezed(told) != ""),
        "text": said == "STRING",
        "texts": said.startswith("ARRAY") & ~F.exists(each, lambda x: F.coalesce(F.schema_of_variant(x) != "STRING", F.lit(True))),
    }[kind.rstrip("?")]
    fits = F.coalesce(fits, F.lit(False))
    return fits | none if kind.endswith("?") else fits & ~none


def shape_violations(rows: DataFrame, shape: dict[str, str], item: str = "v", unique: str | None = None) -> DataFrame:
    """A row a violation: the other columns of ``rows`` and ``rule``; ``item`` is a variant, an element of a JSON array.

    Elements must be objects (rule ``object``) and their fields of the kinds of ``shape`` (rule ``shape_<field>``, see
    ``KINDS``); an element that isn't an object breaks no further rule. All rules are judged in one pass over the rows.
    ``unique`` is a column of which repeats are a violation (rule ``repeated``) of the rows behind the first by ``ord``.
    """
    v, others = F.col(item), [c for c in rows.columns if c != item]
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    broken = [F.when(is_object & ~_fits(F.try_variant_get(v, f"$.{f}", "variant"), kind), F.lit(f"shape_{f}")) for f, kind in shape.items()]
    listed = F.filter(F.array(F.when(~is_object, F.lit("object")), *broken), lambda x: x.isNotNull())
    out = rows.select(*others, F.explode(listed).alias("rule"))
    if unique:
        again = rows.select(*others).filter(F.col(unique).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(unique).orderBy("ord"))).filter("_n > 1").drop("_n")
        out = out.unionByName(again.withColumn("rule", F.lit("repeated")))
    return out


def validate_set(df: DataFrame, least: int) -> DataFrame:
    """One row ``ok``, ``reason`` for rows with name, sub_role, chamber: size, duplicates (15 %, 2 at least), blank fields."""
    name, n = F.nullif(compact_name(F.col("name")), F.lit("")), F.count("*")
    broken = (squeezed(F.col("sub_role")) == "") | name.isNull() | (squeezed(F.col("chamber")) == "")
    sums = df.agg(n.alias("n"), (n - F.countDistinct(name)).alias("twice"), F.count_if(broken).alias("broken"))
    reason = (
        F.when(F.col("n") == 0, "empty")
        .when(F.col("n") < least, F.concat(F.lit("too-small:"), F.col("n").cast("string")))
        .when(F.col("twice") > F.greatest(F.lit(2), F.floor(F.col("n") * 0.15)), F.concat(F.lit("too-many-duplicates:"), F.col("twice").cast("string")))
        .when(F.col("broken") > 0, F.concat(F.lit("invalid-rows:"), F.col("broken").cast("string")))
        .otherwise("ok")
    )
    return sums.select((reason == "ok").alias("ok"), reason.alias("reason"))


def gated_publish(new: DataFrame, old: DataFrame, least: int, merge=None) -> DataFrame:
    """The new rows (merged with the old ones by ``merge``) if they are valid before and after, else the old ones.

    What is judged is stored first, so that the rows judged are the rows returned and nothing is computed twice.
    """
    new = stored(new, "new")
    if not validate_set(new, least).first()["ok"]:
        return old
    merged = stored(merge(new, old), "merged") if merge else new
    return merged if validate_set(merged, least).first()["ok"] else old
