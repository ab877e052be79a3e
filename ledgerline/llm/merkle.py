"""Merkle manifest of a table: a tree of 16 a node for each source, and one over the sources.

A row's leaf is the hash of its fields, each with its length. Rows are sorted by source,
doc_id and leaf in ranges; sums of rows a range and source give every leaf its position in
its source, so no source is ordered by one task. Level by level, lag and lead columns of
fixed offsets 1 to 15 over a run of 16 nodes, masked by the node's slot and by the length of
its run, are a node's siblings, and the first node of a run hashes the parent. Siblings of
upper levels come down as a path of (left, right) strings, one join for 16 leaves.

A proof is the path of a leaf; folding any leaf along it gives the root only if it is the
leaf the path was made for.

Cases: null fields are '-' in the hash; a null source is a source of its own, the first
one; null ids come first in their source; rows of equal id are ordered by leaf, and equal
rows travel as one row with a count until their positions are known; a null or empty text
and a very long one are hashed like any other; an empty table gives no rows and has no
root; further columns are neither read nor hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.linededup import lowered
from ledgerline.llm.ranked import with_position
from ledgerline.llm.rows import table
from ledgerline.operators.ranks import attach
from ledgerline.sources.writers import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # one in so many ids
CHUNK = FANOUT**3  # positions of equal rows that are listed at once
BROADCAST_TREES = 2_000  # sources whose paths (some 5 kB each) are sent to every task
PATH = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return sha(F.concat(*[field(text if name == "text" else F.col(name)) for name in FIELDS]))


def tampered(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, source, digest, changed, n, _id), in order of source, doc_id and digest; `n` equal
    rows are one. `changed` is the leaf of the tampered row, null where nothing is tampered with."""
    text = F.col("text").cast("string")
    changed = F.when(tampered(), leaf_of(lowered(text)))
    rows = docs.select("doc_id", "source", leaf_of(text).alias("digest"), changed.alias("changed"))
    rows = rows.groupBy("source", "doc_id", "digest", "changed").agg(F.count("*").alias("n"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("_id", F.monotonically_increasing_id()), "leaves")


def placed(rows: DataFrame) -> DataFrame:
    """Adds `tree` (number of the source, null first), `size` (rows of the source) and `start`
    (position of the row in its source, or of the first of its equal rows)."""
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    sums = written(rows.groupBy("_part", "source").agg(F.sum("n").alias("_rows")), "leaf-sums")
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows")).drop("_rows")
    sources = with_position(sums.groupBy("source").agg(F.sum("_rows").alias("size")), "source", "tree")
    has_null = sources.filter("source is null").limit(1).count()
    sources = sources.withColumn("tree", F.when(F.col("source").isNull(), F.lit(0)).otherwise(F.col("tree") + has_null))
    inside = Window.partitionBy("_part", "source").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum("n").over(inside) - F.col("n"))
    rows = attach(attach(rows, offsets, ["_part", "source"]), sources, ["source"])
    return rows.withColumn("start", F.col("_before") + F.col("_inside")).drop("_id", "_part", "_before", "_inside")


def one_by_one(rows: DataFrame) -> DataFrame:
    """A row for each leaf, at `position`; many equal rows are listed by many tasks."""
    single = rows.filter("n = 1").withColumn("position", F.col("start"))
    last = F.col("start") + F.col("n") - 1

    def chunk(place: Column) -> Column:
        return F.floor(place / CHUNK)

    many = rows.filter("n > 1").withColumn("_chunk", F.explode(F.sequence(chunk(F.col("start")), chunk(last))))
    first = F.greatest(F.col("start"), F.col("_chunk") * CHUNK)
    many = many.repartition("tree", "_chunk").withColumn("position", F.explode(F.sequence(first, F.least(last, F.col("_chunk") * CHUNK + CHUNK - 1))))
    return single.unionByName(many.drop("_chunk")).drop("start", "n")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds `run`, `left` and `right` (the digests of the run's other nodes) to (tree, position, size, digest)."""
    nodes = nodes.withColumn("run", F.floor(F.col("position") / FANOUT))
    order = Window.partitionBy("tree", "run").orderBy("position")
    slot = (F.col("position") % FANOUT).cast("int")
    length = F.least(F.lit(FANOUT), F.col("size") - F.col("run") * FANOUT)
    before = {f"_lag{k}": F.lag("digest", k).over(order) for k in range(1, FANOUT)}
    after = {f"_lead{k}": F.lead("digest", k).over(order) for k in range(1, FANOUT)}
    wide = nodes.withColumns(before | after)
    left = F.concat_ws("", *[F.when(slot >= k, F.col(f"_lag{k}")) for k in reversed(range(1, FANOUT))])
    right = F.concat_ws("", *[F.when(slot + k < length, F.col(f"_lead{k}")) for k in range(1, FANOUT)])
    return wide.withColumns({"left": left, "right": right}).drop(*before, *after)


def parents(runs: DataFrame) -> DataFrame:
    first = runs.filter(F.col("position") % FANOUT == 0)
    size = F.ceil(F.col("size") / FANOUT)
    return first.select("tree", F.col("run").alias("position"), size.alias("size"), sha(F.concat("digest", "right")).alias("digest"))


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the root of each tree: tree, digest; the paths above each run of 16 nodes: tree, run, above)
    of nodes (tree, position, size, digest). One small job a level, of which there are log16 of the nodes."""
    nodes = nodes.select("tree", "position", "size", "digest")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    roots = nodes.filter("size = 1").select("tree", "digest")
    levels = []
    while largest > 1:
        nodes = written(parents(with_siblings(nodes.filter("size > 1"))), "merkle-level")
        roots = roots.unionByName(nodes.filter("size = 1").select("tree", "digest"))
        levels.append(nodes)
        largest = -(-largest // FANOUT)
    above = nodes.limit(0).select("tree", F.col("position").alias("run"), F.array().cast(PATH).alias("above"))
    for nodes in reversed(levels):
        own = with_siblings(nodes).join(above, ["tree", "run"], "left")
        path = F.when(F.col("size") > 1, F.concat(F.array(F.struct("left", "right")), F.coalesce("above", F.array().cast(PATH))))
        above = written(own.select("tree", F.col("position").alias("run"), F.coalesce(path, F.array().cast(PATH)).alias("above")), "merkle-paths")
    return roots, above


def full_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Adds `path` to nodes (tree, position, size, digest, ...): siblings from the node up to its tree's root."""
    rows = with_siblings(nodes).join(above, ["tree", "run"], "left")
    path = F.concat(F.array(F.struct("left", "right")), F.coalesce("above", F.array().cast(PATH)))
    return rows.withColumn("path", F.when(F.col("size") > 1, path).otherwise(F.array().cast(PATH))).drop("left", "right", "above", "run")


def proof(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda digest, x: sha(F.concat(x["left"], digest, x["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, position, digest, changed, subroot, root, path) of every row."""
    base = written(placed(leaves(docs)), "leaves-placed")
    base = one_by_one(base)
    subroots, above = trees(base)
    count = subroots.count()
    sources = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("position"), F.lit(count).cast("bigint").alias("size"), "digest")
    sources = written(sources, "merkle-sources")
    top, over = trees(sources)
    found = top.first()
    tops = full_paths(sources, over).select(F.col("position").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("top"))
    tops = written(tops, "merkle-tops")
    rows = full_paths(base, above).join(F.broadcast(tops) if count <= BROADCAST_TREES else tops, "tree")
    root = F.lit(found["digest"] if found else None).cast("string")
    return rows.select("doc_id", "source", "position", "digest", "changed", "subroot", root.alias("root"), F.concat("path", "top").alias("path"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents").select(*FIELDS))
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("path")))
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", sha(proof(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 7, top_levels: int = 6) -> str:
    """The statement holds 16 ** levels rows a source and 16 ** top_levels sources; levels above a root pass it on."""
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar"]
    cell = "case when {0} is null then '-' else strlen({0}) || ':' || {0} end"
    heads = " || ".join(cell.format(f) for f in fields)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(range(1, 1 + len(id_text)), lambda i: list_transform(range(8), lambda j: (ascii(substr(id_text, i::bigint, 1)) >> j::int) & 1)))"
    crc = f"xor(4294967295::bigint, list_reduce({bits}::bigint[], lambda c, b: xor(c >> 1, case when xor(c & 1, b) = 1 then 3988292384::bigint else 0 end), 4294967295::bigint))"
    window = "over (partition by tree, pos // 16 order by pos rows between {})"

    def grown(name: str, count: int) -> list[str]:
        out = []
        for k in range(count):
            sides = [f"coalesce(string_agg(digest, '') {window.format(w)}, '') as {side}" for side, w in (("l", "unbounded preceding and 1 preceding"), ("r", "1 following and unbounded following"))]
            out.append(f"{name}s{k} as (select tree, pos, size, digest, {', '.join(sides)} from {name}{k})")
            out.append(
                f"{name}{k + 1} as (select tree, pos // 16 as pos, (size + 15) // 16 as size, "
                f"case when size > 1 then sha256(string_agg(digest, '' order by pos)) else min(digest) end as digest from {name}{k} group by tree, pos // 16, size)"
            )
        return out

    steps = [
        f"marked as (select doc_id, row_number() over () as row_no, source, doc_id::varchar as id_text, "
        f"sha256({heads} || {cell.format('text')}) as leaf, sha256({heads} || {cell.format(low)}) as lowered from documents)",
        f"based as (select *, case when {crc} % 5 = 0 then lowered else leaf end as own, dense_rank() over (order by source nulls first) - 1 as tree, "
        "row_number() over (partition by source order by doc_id nulls first, leaf, row_no) - 1 as pos, count(*) over (partition by source) as size from marked)",
        "n0 as (select tree, pos, size, leaf as digest from based)",
        *grown("n", levels),
        f"t0 as (select 0 as tree, tree as pos, count(*) over () as size, digest from n{levels})",
        *grown("t", top_levels),
    ]
    state = "select doc_id, leaf, tree, pos, ''::varchar as proof, own as acc from based"
    for name, count, at in (("n", levels, "a.tree = s.tree and a.pos // {} = s.pos"), ("t", top_levels, "s.tree = 0 and a.tree // {} = s.pos")):
        for k in range(count):
            steps.append(f"f{name}{k} as ({state})")
            state = (
                "select a.doc_id, a.leaf, a.tree, a.pos, case when s.size > 1 then a.proof || s.l || s.r else a.proof end as proof, "
                f"case when s.size > 1 then sha256(s.l || a.acc || s.r) else a.acc end as acc from f{name}{k} a join {name}s{k} s on {at.format(16**k)}"
            )
    steps.append(f"done as ({state})")
    return (
        f"with {', '.join(steps)} select d.doc_id, d.leaf, n.digest as subroot, t.digest as root, sha256(d.proof) as proof_sha256, "
        f"d.acc as folded_root, d.acc = t.digest as verified from done d join n{levels} n on d.tree = n.tree cross join t{top_levels} t"
    )


OP11_SQL = _sql()
