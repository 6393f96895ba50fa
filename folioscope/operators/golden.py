"""Golden anchors: expectations of results, held against DataFrames by Spark.

An anchor names an artifact (a DataFrame of one row, such as a JSON summary that Spark has read) and one or more places in
it. Every place becomes a fact: how many rows it fits, of what kind its value is, and the value. Facts and expectations
then meet in one table, and each operator is a condition over its columns. Kinds come from the artifact's schema, so whole
numbers, fractions, texts and booleans are never taken for each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.DecimalType: "float", T.StringType: "str", T.BooleanType: "bool"}
_PYTHON = {bool: "bool", int: "int", float: "float", str: "str"}
#: A fact: kind is null where the place isn't there, and says why in text.
_FACT = "anchor_id string, operand string, place int, fits bigint, kind string, whole bigint, number double, text string"
_RULE = "anchor_id string, operator string, kind string, whole bigint, number double, text string, tolerance double, minimum double, maximum double, left string, right string, problem string"


def _path(path: str | list[str]) -> list[str]:
    return path.split(".") if isinstance(path, str) else list(path)


def _type_at(schema: T.DataType, path: list[str]) -> T.DataType | None:
    """The type of a nested field; None where there is none."""
    return reduce(lambda t, part: t[part].dataType if isinstance(t, T.StructType) and part in t.names else None, path, schema)


def _column(path: list[str], start: str = "") -> Column:
    return F.col(start + ".".join(f"`{p}`" for p in path))


def _values(value: Column, kind: str | None) -> list[Column]:
    """whole, number and text of a value of a kind."""
    none = lambda t: F.lit(None).cast(t)
    number = kind in ("int", "float")
    return [value.cast("bigint") if kind == "int" else none("bigint"), value.cast("double") if number else none("double"), none("string") if number or kind is None else value.cast("string")]


def _fact(artifact: DataFrame, anchor: str, name: str, place: int, selector: dict) -> DataFrame:
    """One row: the fact that a selector names in an artifact.

    json_path is a place in the row; filter has list_path (an array of structs), where (field to value) and value_path.
    """
    head = [F.lit(anchor).alias("anchor_id"), F.lit(name).alias("operand"), F.lit(place).alias("place")]

    def missing(why: str) -> DataFrame:
        return artifact.limit(1).select(*head, F.lit(0).cast("bigint").alias("fits"), F.lit(None).cast("string").alias("kind"), *[c.alias(n) for c, n in zip(_values(F.lit(None), None), ("whole", "number", "text"), strict=True)]).withColumn("text", F.lit(why))

    if rule := selector.get("filter"):
        listed = _type_at(artifact.schema, _path(rule["list_path"]))
        if not (isinstance(listed, T.ArrayType) and isinstance(listed.elementType, T.StructType)):
            return missing("no list of rows")
        rows, schema, inner = artifact.select(F.explode(_column(_path(rule["list_path"]))).alias("r")), listed.elementType, _path(rule["value_path"])
        for field, wanted in rule["where"].items():
            held = _type_at(schema, [field])
            alike = held is not None and _KINDS.get(type(held)) == _PYTHON.get(type(wanted))
            rows = rows.where(_column([field], "r.") == F.lit(wanted) if alike else F.lit(False))
        start = "r."
    elif "json_path" in selector:
        rows, schema, inner, start = artifact, artifact.schema, _path(selector["json_path"]), ""
    else:
        return missing("neither json_path nor filter")
    kind = _KINDS.get(type(_type_at(schema, inner)))
    if kind is None:
        return missing("no such value")
    # a filter that fits nothing, or more than one row, still gives one fact
    found = rows.select(_column(inner, start).alias("v")).agg(F.count("*").alias("fits"), F.first("v").alias("v"))
    return found.select(*head, "fits", F.when(F.col("v").isNotNull(), F.lit(kind)).alias("kind"), *[c.alias(n) for c, n in zip(_values(F.col("v"), kind), ("whole", "number", "text"), strict=True)])


def _rule(anchor: dict, operands: list[str]) -> tuple:
    wanted = anchor.get("expected")
    kind = _PYTHON.get(type(wanted))
    whole = wanted if kind == "int" else None
    number = float(wanted) if kind in ("int", "float") else None
    text = None if wanted is None or number is not None else str(wanted).lower() if kind == "bool" else wanted
    limits = [None if anchor.get(k) is None else float(anchor[k]) for k in ("tolerance", "minimum", "maximum")]
    limits[1] = float(anchor["minimum_difference"]) if "minimum_difference" in anchor else limits[1]
    left, right = (anchor.get(f"{side}_operand", operands[k] if k < len(operands) else None) for k, side in enumerate(("left", "right")))
    return anchor["anchor_id"], anchor["operator"], kind, whole, number, text, *limits, left, right, "two operands have one name" if len(set(operands)) < len(operands) else None


def run(spark: SparkSession, anchors: list[dict], artifacts: dict[str, DataFrame]) -> DataFrame:
    """anchor_id, operator, status (pass, fail, error) and what was found, of each anchor.

    Operators: equal (kind and value), approx (within tolerance of expected), between (minimum, maximum), at_least
    (minimum), sum_equal (of all operands, kind and value), difference_at_least (left_operand less right_operand, by
    default the first two; minimum_difference). An error is a place that isn't there, a filter that doesn't fit one row, a
    value that is no number where one is needed, operands of one name, an unknown operator or artifact.
    """
    facts, rules = [], []
    for anchor in anchors:
        selectors = [(s if isinstance(s, dict) else {"name": s, "json_path": s}) for s in anchor.get("operands") or [anchor | {"name": "value"}]]
        rules.append(_rule(anchor, [s["name"] for s in selectors]))
        if (artifact := artifacts.get(anchor["artifact"])) is not None:
            facts += [_fact(artifact, anchor["anchor_id"], s["name"], k, s) for k, s in enumerate(selectors)]
    rule = spark.createDataFrame(rules, _RULE)
    fact = reduce(DataFrame.unionAll, facts) if facts else spark.createDataFrame([], _FACT)
    named = lambda which: F.max(F.when(F.col("operand") == F.col(which), F.col("number"))).alias(f"{which}_number")
    joined = rule.select(*[F.col(c).alias(c if c in ("anchor_id", "operator", "tolerance", "minimum", "maximum", "left", "right", "problem") else f"wanted_{c}") for c in rule.columns]).join(fact, "anchor_id", "left")
    seen = joined.groupBy("anchor_id").agg(
        *[F.first(c).alias(c) for c in ("operator", "tolerance", "minimum", "maximum", "wanted_kind", "wanted_whole", "wanted_number", "wanted_text", "problem")], F.count("operand").alias("operands"),
        F.bool_and((F.col("fits") == 1) & F.col("kind").isNotNull()).alias("there"), F.bool_and(F.coalesce(F.col("kind").isin("int", "float"), F.lit(False))).alias("numbers"), F.bool_and(F.col("kind") == "int").alias("whole_numbers"),
        F.min_by("kind", "place").alias("kind"), F.sum("whole").alias("whole"), F.sum("number").alias("number"), F.min_by("text", "place").alias("text"), named("left"), named("right"),
    )
    sum_kind = F.when(F.col("whole_numbers"), "int").otherwise("float")
    same = lambda kind: (kind == F.col("wanted_kind")) & F.when(kind == "int", F.col("whole") == F.col("wanted_whole")).when(kind == "float", F.col("number") == F.col("wanted_number")).otherwise(F.col("text") == F.col("wanted_text"))
    difference = F.col("left_number") - F.col("right_number")
    holds = {
        "equal": same(F.col("kind")), "approx": F.abs(F.col("number") - F.col("wanted_number")) <= F.col("tolerance"), "between": F.col("number").between(F.col("minimum"), F.col("maximum")),
        "at_least": F.col("number") >= F.col("minimum"), "sum_equal": same(sum_kind), "difference_at_least": difference >= F.col("minimum"),
    }
    ok = reduce(lambda case, name: case.when(F.col("operator") == name, holds[name]), list(holds)[1:], F.when(F.col("operator") == "equal", holds["equal"]))
    known = F.col("operator").isin(*holds) & F.col("problem").isNull() & (F.col("operands") > 0) & F.coalesce("there", F.lit(False)) & ((F.col("operator") == "equal") | F.col("numbers"))
    shown = F.when(F.col("operator") == "difference_at_least", difference.cast("string")).when(F.col("whole_numbers"), F.col("whole").cast("string")).when(F.col("numbers"), F.col("number").cast("string")).otherwise(F.col("text"))
    # a comparison with what the anchor doesn't give is unknown: an error, unless a kind differs
    status = F.when(~known, "error").when(ok, "pass").when(ok.isNull() & (F.col("operator") != "equal") & (F.col("operator") != "sum_equal"), "error").otherwise("fail")
    return seen.select("anchor_id", "operator", status.alias("status"), F.coalesce("problem", shown).alias("found"))
