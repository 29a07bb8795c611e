"""A Merkle manifest of a table with a proof for every row, by octopus multiproofs of blocks.

Leaves are the SHA-256 of a row's fields. Per ``lang`` the leaves stand in doc_id order; every run
of 8 nodes becomes the hash of their hex digests joined, level by level, until one node, the
subroot, is left; the subroots in ``lang`` order give the root the same way.

The leaves of a lang are dealt into blocks: aligned subtrees of ``8 ** block_levels`` leaves (512), so a
hot lang is spread over many blocks of a bounded size. Each block (one group of an
``applyInPandas``) derives its own interior nodes and the part of every proof inside it. The nodes
its leaves miss are the same for all of them: the siblings of the block's root on the way up. The
levels above the blocks are built by grouping runs of 8, and the missing nodes are gathered top
down, each level joining only its parents, so that no node is read by more than 8 children. A block
fetches its list once and every leaf expands its own proof and folded root from it by built-in
expressions.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlake.llm.store import keep

FANOUT = 8
BLOCK_LEVELS = 3
DIGEST = 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the unsigned CRC-32 of the decimal doc_id; else the text."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _block(frame: pd.DataFrame, block_levels: int) -> pd.DataFrame:
    """Interior nodes of one block, and per leaf its siblings inside the block and its folded node."""
    frame = frame.sort_values("idx", kind="stable")
    nodes = frame["leaf"].tolist()
    folds = frame["tleaf"].tolist()
    whole = int(frame["n_lang"].iat[0]) <= FANOUT**block_levels
    position = list(range(len(nodes)))
    sibs = [[] for _ in nodes]
    level = 0
    while (len(nodes) > 1) if whole else (level < block_levels):
        runs = ["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        parents = [_h(r) for r in runs]
        for j, a in enumerate(position):
            run, o = runs[a // FANOUT], a % FANOUT
            own = run[DIGEST * o : DIGEST * o + DIGEST]
            rest = run[: DIGEST * o] + run[DIGEST * o + DIGEST :]
            sibs[j].append(rest)
            folds[j] = parents[a // FANOUT] if folds[j] == own else _h(rest[: DIGEST * o] + folds[j] + rest[DIGEST * o :])
            position[j] = a // FANOUT
        nodes, level = parents, level + 1
    out = frame[["row", "lang", "block", "idx", "doc_id", "leaf"]].copy()
    out["local_sibs"] = ["".join(s) for s in sibs]
    out["local_fold"] = folds
    out["block_root"] = nodes[0]
    return out


def _on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _climb(nodes: DataFrame, key: str, largest: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels above ``nodes`` (key, idx, h, n: nodes of the key at this level) until one node per key.

    Returns per level the child edges (key, idx, parent, pos, sibs) and the tops (key, h) that end there.
    """
    edges, tops = [], []
    current, level = keep(nodes, "merkle-level"), 0
    while True:
        tops.append(current.filter(F.col("n") == 1).select(key, "h"))
        if FANOUT**level >= largest:
            break
        grouped = (
            current.filter(F.col("n") > 1)
            .groupBy(key, F.floor(F.col("idx") / FANOUT).alias("parent"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("kids"))
            .withColumn("run", F.array_join(F.transform("kids", lambda k: k["h"]), ""))
        )
        grouped = keep(grouped, "merkle-run")
        edge = grouped.select(key, "parent", "run", F.explode(F.transform("kids", lambda k: k["idx"])).alias("idx"))
        pos = F.col("idx") % FANOUT
        edges.append(
            edge.select(
                key, "idx", "parent", pos.cast("int").alias("pos"),
                F.expr(f"concat(substr(run, 1, {DIGEST} * (idx % {FANOUT})), substr(run, {DIGEST} * (idx % {FANOUT}) + {DIGEST + 1}))").alias("sibs"),
            )
        )
        current = keep(grouped.select(key, F.col("parent").alias("idx"), F.sha2("run", 256).alias("h"), F.ceil(F.col("n") / FANOUT).alias("n")), "merkle-level")
        level += 1
    return edges, tops


def _descend(edges: list[DataFrame], tops: list[DataFrame], top_paths: DataFrame, key: str) -> DataFrame:
    """Paths (key, idx, path) of the nodes of level 0: each level joins only its parents."""
    path_type = "array<struct<pos:int,sibs:string>>"

    def started(level: int) -> DataFrame:
        t = tops[level]
        return t.join(top_paths, _on(t, top_paths, [(key, key)])).select(t[key], F.lit(0).cast("long").alias("idx"), top_paths["path"].cast(path_type))

    paths = started(len(tops) - 1)
    for level in range(len(edges) - 1, -1, -1):
        e = edges[level]
        joined = e.join(paths, _on(e, paths, [(key, key)]) & (e["parent"] == paths["idx"]))
        below = joined.select(e[key], e["idx"].cast("long"), F.concat(F.array(F.struct(e["pos"], e["sibs"])), paths["path"]).cast(path_type).alias("path"))
        paths = keep(below.unionByName(started(level)), "merkle-paths")
    return paths


FOLD = "aggregate(path, local_fold, (acc, x) -> sha2(concat(substr(x.sibs, 1, 64 * x.pos), acc, substr(x.sibs, 64 * x.pos + 1)), 256))"


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a lang ascend by doc_id (null first), equal doc_ids by leaf; langs ascend bytewise, null
    first. proof_sha256 is the hash of all siblings, level by level up to the root, left to right;
    a lone node has none at its level. folded_root is the root recomputed from the leaf of the
    tampered row (A-Z of text lower-cased where 3 divides the CRC-32 of doc_id) and the original
    siblings; verified says it equals root. Repeated rows are separate leaves with equal hashes.
    Columns other than the five fields are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf(*[F.col(c) for c in FIELDS]).alias("leaf"),
        leaf(*[F.col(c) for c in FIELDS[:4]], tampered(F.col("doc_id"), F.col("text"))).alias("tleaf"),
    )
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ordered = keep(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"pid": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "merkle-ordered",
    )
    # Offsets of each partition's run of a lang: one row per (partition, lang).
    runs = ordered.groupBy("pid", "lang").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first"))
    by_lang = Window.partitionBy("lang").orderBy("pid")
    runs = keep(
        runs.select(
            "pid", "lang", "first",
            (F.sum("c").over(by_lang.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
            F.sum("c").over(Window.partitionBy("lang")).alias("n_lang"),
        ),
        "merkle-runs",
    )
    placed = ordered.join(runs, _on(ordered, runs, [("pid", "pid"), ("lang", "lang")])).select(
        ordered["row"], ordered["lang"], ordered["doc_id"], "leaf", "tleaf", "n_lang",
        (F.coalesce(runs["before"], F.lit(0)) + ordered["row"] - runs["first"]).alias("idx"),
    )
    span = FANOUT**block_levels
    placed = placed.withColumn("block", F.floor(F.col("idx") / span))
    schema = "row long, lang string, block long, idx long, doc_id long, leaf string, local_sibs string, local_fold string, block_root string"
    blocks = keep(placed.groupBy("lang", "block").applyInPandas(lambda f: _block(f, block_levels), schema), "merkle-blocks")

    # Block roots of langs with several blocks climb to their subroots.
    roots = keep(blocks.groupBy("lang", "block").agg(F.first("block_root").alias("h")), "merkle-roots")
    counts = keep(runs.groupBy("lang").agg(F.first("n_lang").alias("n_lang")), "merkle-langs")
    roots = roots.join(counts, _on(roots, counts, [("lang", "lang")])).select(
        roots["lang"], roots["block"].alias("idx"), "h", F.ceil(counts["n_lang"] / span).alias("n")
    )
    largest = counts.agg(F.max("n_lang")).first()[0] or 0
    edges, tops = _climb(roots.filter(F.col("n") > 1), "lang", -(-largest // span)) if largest > span else ([], [])
    subroots = keep(_union([roots.filter(F.col("n") == 1).select("lang", "h"), *tops]), "merkle-subroots")

    # Subroots in lang order climb to the root.
    ranked = subroots.select(
        F.lit(0).alias("g"), "lang", F.col("h"),
        (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).cast("long").alias("idx"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    ranked = keep(ranked, "merkle-ranked")
    n_langs = ranked.count()
    lang_edges, lang_tops = _climb(ranked.select("g", "idx", "h", "n"), "g", n_langs)
    root_row = lang_tops[-1].first()
    root = root_row["h"] if root_row else None
    empty = spark.createDataFrame([(0, [])], "g int, path array<struct<pos:int,sibs:string>>")
    lang_paths = _descend(lang_edges, lang_tops, empty, "g")
    lang_paths = ranked.join(lang_paths, "idx").select("lang", "h", "path")

    # Missing nodes of each block, gathered top down.
    if edges:
        top_paths = lang_paths.select("lang", "path")
        block_paths = _descend(edges, tops, top_paths, "lang").withColumnRenamed("idx", "block")
    else:
        block_paths = spark.createDataFrame([], "lang string, block long, path array<struct<pos:int,sibs:string>>")
    single = roots.filter(F.col("n") == 1).select("lang", F.col("idx").alias("block"))
    single = single.join(lang_paths, _on(single, lang_paths, [("lang", "lang")])).select(single["lang"], "block", "path")
    block_paths = block_paths.unionByName(single)
    named = lang_paths.select(F.col("lang").alias("sub_lang"), F.col("h").alias("subroot"))
    block_paths = keep(block_paths.join(named, block_paths["lang"].eqNullSafe(named["sub_lang"]), "left").drop("sub_lang"), "merkle-block-paths")

    done = blocks.join(block_paths, _on(blocks, block_paths, [("lang", "lang"), ("block", "block")]), "left")
    sibs_up = F.array_join(F.transform(block_paths["path"], lambda x: x["sibs"]), "")
    folded = F.expr(FOLD)
    return done.select(
        blocks["doc_id"], blocks["leaf"], block_paths["subroot"], F.lit(root).alias("root"),
        F.sha2(F.concat(blocks["local_sibs"], sibs_up), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
