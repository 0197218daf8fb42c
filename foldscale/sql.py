"""Spark SQL over a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def features_view(spark: SparkSession, path: str) -> DataFrame:
    """The view ``features`` over a Parquet file, or over ``features.parquet`` in a folder."""
    table = spark.read.parquet(path if path.rstrip("/").endswith(".parquet") else f"{path.rstrip('/')}/features.parquet")
    table.createOrReplaceTempView("features")
    return table


def _is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed statement holds no command and writes nothing, wherever in it; DESCRIBE, SHOW and EXPLAIN may be."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's error comes through the gateway
        raise ValueError(f"not a query: {e}") from e
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if plan.getClass().getSimpleName().startswith(("Describe", "Show", "Explain")):
        return True
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if command.isInstance(node) or name.startswith(("Insert", "Compound", "Create", "Replace", "Merge", "Delete", "Update")):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def query(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """A query over ``features``; other statements are refused."""
    if not _is_query(spark, sql):
        raise ValueError("only queries are allowed")
    features_view(spark, path)
    return spark.sql(sql)


def text_table(df: DataFrame) -> str:
    rows = [[str(c) for c in df.columns], *([("" if v is None else str(v)) for v in r] for r in df.collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    lines = ["| " + " | ".join(v.ljust(w) for v, w in zip(r, width, strict=True)) + " |" for r in rows]
    return "\n".join([rule, lines[0], rule, *lines[1:], rule])
