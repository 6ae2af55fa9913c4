"""Gene set enrichment on a ranked list."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.operators import ordered
from tessera.operators.ordered import attach
from tessera.session import cut_lineage


def signal_to_noise(samples: DataFrame, gene: str, value: str, positive: Column) -> DataFrame:
    """(mean1 - mean2) / (sd1 + sd2) per gene; a deviation is at least a fifth
    of its mean."""
    a, b = F.when(positive, F.col(value)), F.when(~positive, F.col(value))
    m = samples.groupBy(gene).agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.stddev_samp(a).alias("s1"), F.stddev_samp(b).alias("s2"))
    sd = lambda s, m: F.greatest(F.coalesce(s, F.lit(0.0)), 0.2 * F.abs(m))
    return m.select(gene, ((F.col("m1") - F.col("m2")) / F.nullif(sd(F.col("s1"), F.col("m1")) + sd(F.col("s2"), F.col("m2")), F.lit(0.0))).alias("metric"))


def enrichment_scores(ranked: DataFrame, hits: DataFrame, keys: Sequence[str], even: bool = False) -> DataFrame:
    """Running-sum score per ``keys``. ``ranked`` has one row of totals ``_n``
    attached to each hit: (keys, rank, metric, _n). Only hits are visited: the
    sum peaks right at a hit and bottoms out right before one. ``even`` says
    that there are many groups, none larger than the others by far (as with
    permutations of one list): then a group is a window."""
    w = F.abs(F.col("metric"))
    if even:
        every = W.partitionBy(*keys)
        upto = every.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
        run = hits.withColumns({"_k": F.row_number().over(every.orderBy("rank")), "_c": F.sum(w).over(upto), "_nr": F.sum(w).over(every), "_nh": F.count(F.lit(1)).over(every)})
    else:
        run = ordered.scan(hits, keys, [F.col("rank")], {"_k": ("count", None), "_c": ("sum", w)})
        total = hits.groupBy(*keys).agg(F.sum(w).alias("_nr"), F.count(F.lit(1)).alias("_nh"))
        run = attach(run, total, list(keys))
    run = attach(run, ranked, [])
    miss = (F.col("rank") - F.col("_k")) / F.nullif(F.col("_n") - F.col("_nh"), F.lit(0))
    high = F.col("_c") / F.nullif(F.col("_nr"), F.lit(0.0)) - miss
    low = (F.col("_c") - w) / F.nullif(F.col("_nr"), F.lit(0.0)) - miss
    both = run.groupBy(*keys).agg(F.max(high).alias("_hi"), F.min(low).alias("_lo"), F.max("_nh").alias("n_hits"))
    es = F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo"))
    return both.select(*keys, es.alias("es"), "n_hits")


def gsea(metric: DataFrame, sets: DataFrame, gene: str, term: str, permutations: int = 1000, seed: int = 7) -> DataFrame:
    """``es``, ``nes`` and nominal ``pval`` per gene set.

    A permutation gives every gene a hashed place in the list. The list goes to
    each of the tasks that share the permutations, not to each permutation: a
    task orders the list anew for each of its own and gives scores only."""
    placed = cut_lineage(ordered.scan(metric, [], [-F.col("metric"), F.col(gene)], {"rank": ("count", None)}))
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    members = sets.select(term, gene).distinct()
    real = enrichment_scores(n, members.join(placed, gene), [term])
    if not permutations:
        return real
    null = permuted_scores(placed, members, gene, term, permutations, seed)
    tested = null.join(real.select(term, F.col("es").alias("_es")), term)
    same = (F.col("es") >= 0) == (F.col("_es") >= 0)
    beyond = same & (F.abs(F.col("es")) >= F.abs(F.col("_es")))
    stats = tested.groupBy(term).agg(
        F.sum(beyond.cast("long")).alias("_b"), F.sum(same.cast("long")).alias("_s"), F.avg(F.when(same, F.abs(F.col("es")))).alias("_scale"))
    return real.join(stats, term).select(
        term, "es", "n_hits", (F.col("es") / F.nullif(F.col("_scale"), F.lit(0.0))).alias("nes"), (F.col("_b") / F.nullif(F.col("_s"), F.lit(0))).alias("pval"))


def permuted_scores(placed: DataFrame, members: DataFrame, gene: str, term: str, permutations: int, seed: int) -> DataFrame:
    """(term, perm, es) of every set under every permutation of ``placed`` (gene, metric, rank)."""
    tasks = min(permutations, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sets = members.groupBy(gene).agg(F.collect_list(term).alias("_sets"))
    rows = placed.join(sets.hint("merge"), gene, "left").select(
        F.col(gene).alias("_gene"), F.col(gene).cast("string").alias("_name"), "rank", F.abs(F.col("metric").cast("double")).alias("_w"), "_sets")
    dealt = rows.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionByRange(tasks, "_task")

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("_gene")
        task, size = table.column("_task")[0].as_py(), table.num_rows
        names = [x.encode() for x in table.column("_name").to_pylist()]
        weight = np.empty(size)  # by rank
        weight[table.column("rank").to_numpy() - 1] = table.column("_w").to_numpy()
        lists = table.column("_sets").combine_chunks()
        owner = np.repeat(np.arange(size), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
        named = lists.flatten().dictionary_encode()
        by_set = np.argsort(named.indices.to_numpy(), kind="stable")
        owner, found = owner[by_set], named.indices.to_numpy()[by_set]
        cuts = np.searchsorted(found, np.arange(len(named.dictionary) + 1))
        which, perms, scores = [], [], []
        for perm in range(task + 1, permutations + 1, tasks):
            tail = f"|{perm}|{seed}".encode()
            places = np.frombuffer(b"".join([md5(x + tail).digest() for x in names]), ">u8").astype(np.uint64).reshape(-1, 2)
            first = np.ascontiguousarray(places[:, 0])
            order = np.argsort(first)
            if (first[order[1:]] == first[order[:-1]]).any():
                order = np.lexsort((places[:, 1], first))
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(1, size + 1)
            for k in range(len(cuts) - 1):
                own = np.sort(rank[owner[cuts[k]:cuts[k + 1]]])
                scores.append(running_score(own, weight[own - 1], size))
            which.append(np.arange(len(cuts) - 1))
            perms.append(np.full(len(cuts) - 1, perm))
        at = np.concatenate(which).astype(np.int64)
        return pa.table({term: named.dictionary.take(pa.array(at)), "perm": pa.array(np.concatenate(perms), pa.int32()),
                         "es": pa.array(np.array(scores, float), from_pandas=True)})

    schema = T.StructType([members.schema[term], T.StructField("perm", T.IntegerType()), T.StructField("es", T.DoubleType())])
    return dealt.groupBy("_task").applyInArrow(score, schema)


def running_score(rank: np.ndarray, weight: np.ndarray, size: int) -> float:
    """``enrichment_scores`` of one set at sorted ranks of a list; missing weights
    are NaN, and so is a score without any weight or other gene."""
    known = ~np.isnan(weight)
    up = np.cumsum(np.where(known, weight, 0.0))
    if not len(rank) or not up[-1] > 0 or size == len(rank):
        return np.nan
    miss = (rank - np.arange(1, len(rank) + 1)) / (size - len(rank))
    high = (up / up[-1] - miss)[np.logical_or.accumulate(known)].max()
    low = ((up - weight) / up[-1] - miss)[known].min()
    return high if high >= -low else low


def differential_overlap(a: DataFrame, b: DataFrame, gene: str, fdr: float = 0.01) -> DataFrame:
    """Genes significant in both tables with the signs of both changes."""
    sig = lambda d, s: d.filter(F.col("FDR") < fdr).select(gene, F.col("logFC").alias(f"logFC_{s}"))
    both = sig(a, "x").join(sig(b, "y"), gene)
    return both.withColumn("same_sign", F.signum("logFC_x") == F.signum("logFC_y"))


def parse_report(report: DataFrame) -> DataFrame:
    """Explode an enrichment report: overlap ``k/n`` and the ``;`` gene list."""
    parts = F.split("Overlap", "/")
    return report.withColumns({"overlap": parts[0].cast("int"), "set_size": parts[1].cast("int"), "gene": F.explode(F.split("Genes", ";"))})
