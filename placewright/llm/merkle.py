"""Operator 11, Merkle manifest of a dataset.

Each row is a leaf, the digest of its fields. The leaves of a source, in order of their ids, are the bottom of a tree in
which FAN consecutive nodes become their digest until one is left, the source's root; the roots of the sources, in their
order, are the bottom of the tree above. A tree is cut into superblocks of FAN ** LEVELS consecutive nodes. Going up, each
round turns a superblock into its top, so a few rounds reduce any number of rows. Going down, the nodes of a superblock
and the siblings that it needs from outside are cogrouped, and one task finishes all that is local: it reduces the
superblock again, joins each leaf's siblings inside to those outside, and folds the leaf, or what it was altered to, up
to the root. No task holds more than a superblock and one path, whatever the size of a source.

Places of leaves come from a range partitioning: rows are numbered inside their partition, and a partition's rows start
where those of the partitions before it ended.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes that become one.
FAN = 16
#: Levels of a tree inside a superblock.
LEVELS = 2
BLOCK = FAN**LEVELS
#: Hexadecimal digits of a digest.
_HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "grp string, pos long, path array<struct<before:string,after:string>>, subroot string, root string"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest_of(*fields: Column) -> Column:
    """The leaf of a row."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` with pos, the place in its `grp` in order of `by`, and n, the rows of the grp.

    The counts that are summed have one row for each partition and group in it: at most partitions plus groups.
    """
    keys = ["grp", *by]
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    spans = ranged.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("grp")
    so_far = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.select("grp", "_part", "_first", (F.sum("_rows").over(so_far) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    placed = ranged.join(written(spans, "spans"), ["grp", "_part"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def level_up(nodes: DataFrame) -> DataFrame:
    """grp, n, pos, digest one level up. Groups of one node are done and stay."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
    above = nodes.where("n > 1").groupBy("grp", F.ceil(F.col("n") / FAN).alias("n"), F.floor(F.col("pos") / FAN).alias("pos"))
    above = above.agg(F.sha2(F.array_join(children, ""), 256).alias("digest"))
    return nodes.where("n = 1").unionByName(above)


def rounds_up(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (grp, n, pos, digest), then the tops of their superblocks and so on; the last has one node for each grp."""
    rounds = [nodes.select("grp", "n", "pos", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        up = rounds[-1]
        for _ in range(LEVELS):
            up = level_up(up)
        rounds.append(written(up, "tops"))
        most = -(-most // BLOCK)
        if most == 1:
            return rounds


def _paths(digests: list[str], n: int) -> list[list[tuple[str, str]]]:
    """For each node of a superblock its siblings before and after it, level by level. n: nodes of the whole group."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]
    level, width = digests, 1
    for _ in range(LEVELS):
        if n == 1:
            break
        runs = ["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        for i, path in enumerate(paths):
            at = i // width
            run, k = runs[at // FAN], at % FAN * _HEX
            path.append((run[:k], run[k + _HEX :]))
        level, width, n = [_hash(r) for r in runs], width * FAN, -(-n // FAN)
    return paths


def _block(nodes: pd.DataFrame, outer: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[str, str]]], pd.Series]:
    """The superblock's nodes in order, their whole paths, and the outer row."""
    nodes = nodes.sort_values("pos", kind="stable").reset_index(drop=True)
    above = outer.iloc[0]
    outside = [(x["before"], x["after"]) for x in above["path"]]
    return nodes, [p + outside for p in _paths(nodes["digest"].tolist(), int(nodes["n"].iloc[0]))], above


def _cogrouped(nodes: DataFrame, outer: DataFrame):  # noqa: ANN202
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("grp", "block")
    return blocks.cogroup(outer.withColumnRenamed("pos", "block").groupBy("grp", "block"))


def outward(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """One round down: the path from each node to the root. outer: grp, pos, path, subroot, root of the nodes a round above."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, paths, above = _block(nodes, outer)
        path = [[{"before": b, "after": a} for b, a in p] for p in paths]
        return pd.DataFrame({"grp": nodes["grp"], "pos": nodes["pos"], "path": path, "subroot": above["subroot"], "root": above["root"]})

    return _cogrouped(nodes, outer).applyInPandas(run, _NODE)


def finished(leaves: DataFrame, outer: DataFrame, proofs: bool) -> DataFrame:
    """The last round: digests of the proofs and folded roots. leaves: grp, n, pos, doc_id, source, digest, altered."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves, paths, above = _block(leaves, outer)
        folded, proved = [], []
        for now, other, path in zip(leaves["digest"], leaves["altered"], paths, strict=True):
            root = other if isinstance(other, str) else now
            for before, after in path:
                root = _hash(f"{before}{root}{after}")
            folded.append(root)
            proved.append(_hash("".join(x for pair in path for x in pair)))
        out = pd.DataFrame({"doc_id": leaves["doc_id"], "source": leaves["source"], "leaf": leaves["digest"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": proved, "folded_root": folded})
        out["verified"] = out["folded_root"] == out["root"]
        if proofs:
            out["proof"] = [[{"before": b, "after": a} for b, a in p] for p in paths]
        return out

    kinds = {c: leaves.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _cogrouped(leaves, outer).applyInPandas(run, schema + (", proof array<struct<before:string,after:string>>" if proofs else ""))


def merkle_manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", source: str = "source", proofs: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the digest of `fields`. altered: Columns that stand for fields when the copy is checked; the folded root is
    recomputed from the leaf of the altered row and the original siblings. proofs: also gives `proof`, the siblings of each
    level from the leaf to the root as (before, after), digests in hexadecimal one after another, from which the digest is
    made and anyone can fold.

    Leaves of a source are in order of `key`, null first, rows of one key in order of their leaf; a repeated row is a leaf of
    its own. Null is a source too, the first. Null and empty fields differ. An empty table gives an empty result. Columns
    that are no field are ignored.
    """
    cols = {f: F.col(f) for f in fields}
    leaf = digest_of(*cols.values())
    other = digest_of(*(cols | altered).values()) if altered else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), F.col(key).alias("doc_id"), F.col(source).alias("source"), leaf.alias("digest"), other.alias("altered"), F.monotonically_increasing_id().alias("tie"))
    leaves = written(leaves, "leaves")
    placed = written(numbered(leaves, ["doc_id", "digest", "tie"], "ranged").drop("tie"), "placed")
    up = rounds_up(placed)
    tops = up[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    sources = written(numbered(tops, ["of"], "sources"), "sources")
    over = rounds_up(sources)
    top = over[-1].select("grp", "pos", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        top = written(outward(nodes, top), "outer")
    outer = sources.join(top.select("pos", "path", "root"), "pos").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(up[1:-1]):
        outer = written(outward(nodes, outer), "outer")
    return finished(placed, outer, proofs)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by the checksum of its id is checked with its text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle_manifest(docs, {"text": F.when(fifth, lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    return out.drop("source")


def oracle(levels: int = 4) -> str:
    """DuckDB SQL for sources of up to 16 ** levels rows, and as many sources."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(f"({enc(c)})" for c in (*FIELDS[:-1], text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce([0,1,2,3,4,5,6,7], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b))"
    crc = f"xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {step}, 4294967295::BIGINT))"
    parts = [
        f"d AS (SELECT doc_id, coalesce('s' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf('x')} ELSE {leaf('text')} END AS bad FROM (SELECT *, {low} AS x FROM documents))",
        "a0 AS (SELECT g, doc_id, bad, leaf, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]
    tree = lambda p: [f"{p}{i} AS (SELECT g, sha256(string_agg(h, '' ORDER BY pos)) AS h, pos // 16 AS pos, (n + 15) // 16 AS n FROM {p}{i - 1} WHERE n > 1 GROUP BY g, n, pos // 16)" for i in range(1, levels + 1)]
    tops = lambda p: f"{p}r AS (" + " UNION ALL ".join(f"SELECT g, h FROM {p}{i} WHERE n = 1" for i in range(levels + 1)) + ")"
    parts += [*tree("a"), tops("a"), "b0 AS (SELECT '' AS g, g AS src, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM ar)", *tree("b"), tops("b")]
    parts.append("f0 AS (SELECT a0.doc_id, a0.g, a0.leaf, a0.pos AS p, b0.pos AS q, bad AS cur, '' AS proof FROM a0 JOIN b0 ON a0.g = b0.src)")
    k = 0
    for p, at in (("a", "p"), ("b", "q")):
        for i in range(levels):
            key = "f.g" if p == "a" else "''"
            k += 1
            inner = f"SELECT f.doc_id, f.leaf, string_agg(CASE WHEN x.pos = f.{at} THEN f.cur ELSE x.h END, '' ORDER BY x.pos) AS s, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> f.{at}), '') AS sib FROM f{k - 1} f JOIN {p}{i} x ON x.g = {key} AND x.n > 1 AND x.pos // 16 = f.{at} // 16 GROUP BY f.doc_id, f.leaf"
            parts.append(f"f{k} AS (SELECT f.doc_id, f.g, f.leaf, {'f.p // 16 AS p, f.q' if p == 'a' else 'f.p, f.q // 16 AS q'}, CASE WHEN y.s IS NULL THEN f.cur ELSE sha256(y.s) END AS cur, f.proof || coalesce(y.sib, '') AS proof FROM f{k - 1} f LEFT JOIN ({inner}) y ON f.doc_id = y.doc_id AND f.leaf = y.leaf)")
    last = f"SELECT f.doc_id, f.leaf, ar.h AS subroot, br.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = br.h AS verified FROM f{k} f JOIN ar ON ar.g = f.g CROSS JOIN br"
    return f"WITH {', '.join(parts)} {last}"


ORACLE = oracle()
