"""Merkle manifest of a dataset: higher-order SQL blocks that collapse fixed-size arrays of ordered leaves.

A leaf is the hash of a row's fields. Within each source, leaves in the order of doc_id are cut into
blocks of ``ARITY ** DEPTH`` positions. A block is one array of nodes; ``sequence``, ``transform`` and
``slice`` make the nodes of the next level, and ``aggregate`` repeats that for the levels of the block,
so that a block leaves one node, its root. Rounds over block roots follow until each source has one
node, its subroot; then the same rounds run over the subroots. Proofs come down the same way: a block
hands each of its nodes the siblings inside the block, followed by what the block itself was handed.

Positions come from a range-partitioned table: the running row number of a partition, less where the
group starts in it, plus the rows of the group in earlier partitions. So a source with a third of all rows is
ranked by all tasks, and no task holds more than a range of rows or a block. All code is built-in functions.
Every level that is read twice is a written table, which a lost executor's tasks read again.

Edge cases: a null field is hashed as ``-``, an empty text as ``0:``, so they differ; a null source comes
first; null doc_ids come first in their source and are never tampered; equal doc_ids are ordered by their
leaf (equal rows have equal leaves and need no order, and all stay); texts of any length are hashed whole
by one task; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, release

ARITY, DEPTH = 16, 2
BLOCK = ARITY**DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def tampered() -> Column:
    """Rows whose text is tampered: 5 divides the crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def group_key(c: Column) -> Column:
    """A key without nulls that sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def height(size: Column) -> Column:
    """Levels above ``size`` leaves: the smallest h with 16 ** h >= size, that is the hex digits of size - 1, or 0 for one leaf."""
    return F.when(size <= 1, 0).otherwise(F.length(F.hex(size - 1)))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (g, ...) with ``pos``, from 0 in each g in the given order, and ``levels`` above the leaves of g."""
    ordered = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    table = materialize(ordered, "merkle-ordered").withColumn("part", F.shiftright("at", 33))
    counts = table.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_group = "(PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = counts.select("g", "part", (F.coalesce(F.expr(f"sum(n) OVER {by_group}"), F.lit(0)) - F.col("first")).alias("shift"), F.expr("sum(n) OVER (PARTITION BY g)").alias("size"))
    out = table.join(starts, ["g", "part"]).withColumns({"pos": F.col("at") + F.col("shift"), "levels": height(F.col("size"))}).drop("at", "part", "shift", "size")
    kept = materialize(out, "merkle-ranked")
    release(table)
    return kept


def collapse(nodes: Column) -> Column:
    """The next level of an array of nodes: a hash for every 16 consecutive ones."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each block of (g, pos, levels, node, *payload): arrays of its nodes, of the next level, and of the payload, and its root.

    ``levels`` counts those still to be made, of which a block makes up to DEPTH.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", "node", *payload)))
    b = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("levels").alias("levels"), items.alias("items"))
    b = b.select("g", "block", "levels", *[F.col(f"items.{c}") for c in ("node", *payload)])
    made = F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: k <= F.col("levels"))
    return b.withColumns({"next": collapse(F.col("node")), "root": F.aggregate(made, F.col("node"), lambda nodes, _: collapse(nodes))[0]})


def siblings(nodes: Column, j: Column) -> Column:
    """What stands before and after item j (from 0) in its run of 16, each put together."""
    run = F.floor(j / ARITY).cast("int") * ARITY
    part = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
    return F.struct(part(run + 1, j - run).alias("before"), part(j + 2, run + ARITY - 1 - j).alias("after"))


def steps(j: Column) -> Column:
    """The siblings of item j at each level that its block makes, from below."""
    both = F.array(siblings(F.col("node"), j), siblings(F.col("next"), F.floor(j / ARITY).cast("int")))
    return F.slice(both, F.lit(1), F.least(F.col("levels"), F.lit(DEPTH)))


def climb(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks of each round from below, and (g, node), the last node of each g."""
    tables, done = [], None
    while True:
        table = materialize(blocks(nodes, payload if not tables else []), "merkle-blocks")
        tables.append(table)
        tops = table.filter(F.col("levels") <= DEPTH).select("g", F.col("root").alias("node"))
        done = tops if done is None else done.unionByName(tops)
        nodes = table.filter(F.col("levels") > DEPTH).select("g", F.col("block").alias("pos"), (F.col("levels") - DEPTH).alias("levels"), F.col("root").alias("node"))
        if nodes.isEmpty():
            return tables, done


def descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Blocks of the lowest round with ``path``, the steps from the block's root up, and what else ``tops`` (g, path, ...) has for their g.

    Each g has one block that makes its last node, so no join has a repeated key, whatever a group's size.
    """
    carried = [c for c in tops.columns if c not in ("g", "path")]
    down = None
    for table in reversed(tables):
        here = table.filter(F.col("levels") <= DEPTH).join(tops, "g")
        if down is not None:
            here = here.unionByName(table.filter(F.col("levels") > DEPTH).join(down, ["g", "block"]))
        if table is tables[0]:
            return here
        child = F.transform(F.sequence(F.lit(0), F.size("node") - 1), lambda j: F.struct((F.col("block") * BLOCK + j).alias("block"), F.concat(steps(j), F.col("path")).alias("path")))
        down = materialize(here.select("g", *carried, F.explode(child).alias("c")).select("g", *carried, "c.block", "c.path"), "merkle-paths")
    raise ValueError("no round")


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(path: Column, node: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, node, lambda acc, s: digest(s["before"], acc, s["after"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of documents."""
    text = F.col("text").cast("string")
    changed = F.when(tampered(), leaf(F.translate(text, UPPER, LOWER)))
    leaves = materialize(docs.select(group_key(F.col("source")).alias("g"), "doc_id", leaf(text).alias("node"), changed.alias("changed")), "merkle-leaves")
    nodes = ranked(leaves, ["doc_id", "node"])
    release(leaves)
    tables, subroots = climb(nodes, ["doc_id", "changed"])
    release(nodes)
    # the sources' own tree: one group, in which a source's subroot is a leaf
    upper = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("source_key"), "node"), ["source_key"])
    roots_of, root = climb(upper, ["source_key"])
    above = descend(roots_of, root.select("g", F.col("node").alias("top"), F.array().cast(STEP).alias("path")))
    each = F.transform(F.sequence(F.lit(0), F.size("node") - 1), lambda j: F.struct(F.col("source_key")[j].alias("g"), F.col("node")[j].alias("subroot"), F.concat(steps(j), F.col("path")).alias("path")))
    tops = materialize(above.select("top", F.explode(each).alias("s")).select("s.g", "s.subroot", "top", "s.path"), "merkle-sources")
    low = descend(tables, tops)
    # siblings are looked up inside the block's arrays, so only the results are exploded
    path = lambda j: F.concat(steps(j), F.col("path"))
    made = F.transform(
        F.sequence(F.lit(0), F.size("node") - 1),
        lambda j: F.struct(
            F.col("doc_id")[j].alias("doc_id"),
            F.col("node")[j].alias("leaf"),
            proof(path(j)).alias("proof_sha256"),
            folded(path(j), F.coalesce(F.col("changed")[j], F.col("node")[j])).alias("folded_root"),
        ),
    )
    out = low.select("subroot", F.col("top").alias("root"), F.explode(made).alias("m"))
    return out.select("m.doc_id", "m.leaf", "subroot", "root", "m.proof_sha256", "m.folded_root", (F.col("m.folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def tree_sql(prefix: str, base: str, keys: str, levels: int) -> str:
    """Levels 1.. of a tree over ``base`` (keys, pos, height, node) and the steps of each of its rows."""
    parts, by = [f"{prefix}0 AS (SELECT {keys}, pos, height, node FROM {base})"], keys
    for k in range(1, levels + 1):
        parts.append(f"{prefix}{k} AS (SELECT {by}, pos // 16 AS pos, any_value(height) AS height, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {prefix}{k - 1} WHERE height >= {k} GROUP BY {by}, pos // 16)")
        parts.append(f"""{prefix}s{k} AS (SELECT l.{by}, l.pos, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < l.pos // {16 ** (k - 1)}), '') AS before,
  coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > l.pos // {16 ** (k - 1)}), '') AS after
  FROM {prefix}0 l JOIN {prefix}{k - 1} n ON n.{by} = l.{by} AND n.pos // 16 = l.pos // {16**k} WHERE l.height >= {k} GROUP BY l.{by}, l.pos)""")
    tops = " UNION ALL ".join(f"SELECT {by}, node FROM {prefix}{k} WHERE height = {k}" for k in range(levels + 1))
    return ",\n".join([*parts, f"{prefix}top AS ({tops})"])


def oracle(levels: int = 4, upper: int = 3) -> str:
    """SQL for sources of up to 16 ** levels rows and up to 16 ** upper sources."""
    f = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    ident = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    h = lambda n: "CASE " + " ".join(f"WHEN {n} <= {16**k} THEN {k}" for k in range(6)) + " ELSE 6 END"
    crc = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce(list_concat([xor(a, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
    sides = [("t", levels, "g = d.g", "d.pos"), ("r", upper, "one = 1", "u.pos")]
    join = "\n  ".join(f"LEFT JOIN {p}s{k} ON {p}s{k}.{on} AND {p}s{k}.pos = {at}" for p, n, on, at in sides for k in range(1, n + 1))
    names = [f"ts{k}" for k in range(1, levels + 1)] + [f"rs{k}" for k in range(1, upper + 1)]
    siblings = " || ".join(f"coalesce({n}.before || {n}.after, '')" for n in names)
    fold = [f"f{i} AS (SELECT *, CASE WHEN b{i} IS NULL THEN h{i - 1} ELSE sha256(b{i} || h{i - 1} || a{i}) END AS h{i} FROM f{i - 1})" for i in range(1, len(names) + 1)]
    return f"""WITH leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({ident} || {f('text')}) AS node,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({ident} || {f("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM documents),
d AS (SELECT *, {h('n')} AS height FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)),
{tree_sql('t', 'd', 'g', levels)},
u AS (SELECT 1 AS one, g, node, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, {h('(SELECT count(*) FROM ttop)')} AS height FROM ttop),
{tree_sql('r', 'u', 'one', upper)},
f0 AS (SELECT d.doc_id, d.node AS leaf, u.node AS subroot, (SELECT node FROM rtop) AS root, sha256({siblings}) AS proof_sha256, coalesce(d.changed, d.node) AS h0,
  {', '.join(f'{n}.before AS b{i}, {n}.after AS a{i}' for i, n in enumerate(names, 1))}
  FROM d JOIN u ON u.g = d.g
  {join}),
{', '.join(fold)}
SELECT doc_id, leaf, subroot, root, proof_sha256, h{len(names)} AS folded_root, h{len(names)} = root AS verified FROM f{len(names)}"""


ORACLE = oracle()
