"""Graph files: GraphML and GEXF as node and edge DataFrames, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: types of graph attributes
_TYPES = {"int": "int", "integer": "int", "long": "long", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}
_BACK = {"int": "int", "integer": "int", "bigint": "long", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}


def _declared(spark: SparkSession, path: str, key_tag: str, of: str) -> list[tuple[str, str, str]]:
    """(key id, name, type) of the attributes a file declares for nodes or edges, wherever it does; a file has as many as its nodes have columns."""
    keys = spark.read.format("xml").option("rowTag", key_tag).schema("_id string, _for string, `_attr.name` string, `_attr.type` string").load(path)
    rows = keys.where(F.col("_id").isNotNull() & (F.coalesce("_for", F.lit(of)).isin(of, "all"))).collect()
    return [(r["_id"], r["_attr.name"] or r["_id"], r["_attr.type"] or "string") for r in rows]


def _section(path: str, spark: SparkSession, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with id, edges with source and target), typed by the declared attributes."""
    data = "data array<struct<_key: string, _VALUE: string>>"

    def typed(df: DataFrame, of: str, fixed: Sequence[Column]) -> DataFrame:
        value = lambda k: F.get(F.filter("data", lambda d: d["_key"] == k), F.lit(0))["_VALUE"]
        return df.select(*fixed, *[value(k).try_cast(_TYPES.get(t, "string")).alias(name) for k, name, t in _declared(spark, path, "key", of)])

    nodes = typed(_section(path, spark, "node", f"_id string, {data}"), "node", [F.col("_id").alias("id")])
    edges = typed(_section(path, spark, "edge", f"_source string, _target string, {data}"), "edge", [F.col("_source").alias("source"), F.col("_target").alias("target")])
    return nodes, edges


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with id and label, edges with source, target and weight) and their attributes as a map of strings."""
    values = "attvalues struct<attvalue: array<struct<_for: string, _value: string>>>"
    attrs = F.map_from_entries(F.transform(F.coalesce("attvalues.attvalue", F.array().cast("array<struct<_for: string, _value: string>>")), lambda x: F.struct(x["_for"], x["_value"])))
    nodes = _section(path, spark, "node", f"_id string, _label string, {values}").select(F.col("_id").alias("id"), F.col("_label").alias("label"), attrs.alias("attributes"))
    edges = _section(path, spark, "edge", f"_source string, _target string, _weight double, {values}").select(F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_weight").alias("weight"), attrs.alias("attributes"))
    return nodes, edges


def _ascii(text: object) -> str:
    return str(text).encode("ascii", "ignore").decode()


def _lines(df: DataFrame, line) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": [line(r) for r in b.to_dict("records")]})

    return df.mapInPandas(run, "value string")


def _write(parts: Sequence[str | DataFrame], path: str) -> None:
    """One XML file of literal lines and of lines streamed from DataFrames, a partition at a time."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="ascii", errors="xmlcharrefreplace") as f:
        for p in parts:
            f.writelines([p + "\n"] if isinstance(p, str) else (r.value + "\n" for r in p.toLocalIterator()))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write nodes (id, ...) and edges (source, target, ...) as one GraphML file; null values are left out."""
    keys = {(of, c): f"{of[0]}{i}" for of, df, own in (("node", nodes, {"id"}), ("edge", edges, {"source", "target"})) for i, c in enumerate(x for x in df.columns if x not in own)}
    types = {"node": dict(nodes.dtypes), "edge": dict(edges.dtypes)}

    def data(of: str, r: dict) -> str:
        return "".join(f'<data key="{k}">{escape(str(r[c]).lower() if isinstance(r[c], bool) else str(r[c]))}</data>' for (o, c), k in keys.items() if o == of and r[c] is not None and r[c] == r[c])

    head = ['<?xml version="1.0" encoding="us-ascii"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'] + [f'<key id="{k}" for="{of}" attr.name={quoteattr(c)} attr.type="{_BACK.get(types[of][c], "string")}"/>' for (of, c), k in keys.items()]
    _write([*head, '<graph edgedefault="undirected">', _lines(nodes, lambda r: f"<node id={quoteattr(str(r['id']))}>{data('node', r)}</node>"), _lines(edges, lambda r: f"<edge source={quoteattr(str(r['source']))} target={quoteattr(str(r['target']))}>{data('edge', r)}</edge>"), "</graph>", "</graphml>"], path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write nodes (id, ...) and edges (source, target, [weight], ...) as GEXF 1.2draft in plain ASCII."""
    own_n, own_e = [c for c in nodes.columns if c != "id"], [c for c in edges.columns if c not in ("source", "target", "weight")]

    def attributes(of: str, df: DataFrame, cols: list[str]) -> str:
        return f'<attributes class="{of}">' + "".join(f'<attribute id="{c}" title={quoteattr(c)} type="{_BACK.get(dict(df.dtypes)[c], "string")}"/>' for c in cols) + "</attributes>"

    def values(r: dict, cols: list[str]) -> str:
        inner = "".join(f'<attvalue for="{c}" value={quoteattr(_ascii(r[c]))}/>' for c in cols if r[c] is not None and r[c] == r[c])
        return f"<attvalues>{inner}</attvalues>"

    node = lambda r: f"<node id={quoteattr(_ascii(r['id']))} label={quoteattr(_ascii(r['id']))}>{values(r, own_n)}</node>"
    edge = lambda r: f"<edge source={quoteattr(_ascii(r['source']))} target={quoteattr(_ascii(r['target']))}" + (f' weight="{r["weight"]}"' if r.get("weight") is not None else "") + f">{values(r, own_e)}</edge>"
    _write(['<?xml version="1.0" encoding="us-ascii"?>', '<gexf version="1.2" xmlns="http://www.gexf.net/1.2draft"><graph defaultedgetype="undirected">', attributes("node", nodes, own_n), attributes("edge", edges, own_e), "<nodes>", _lines(nodes, node), "</nodes><edges>", _lines(edges, edge), "</edges></graph></gexf>"], path)
