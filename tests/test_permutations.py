"""Permutations are spread over tasks and agree with a plain count."""

from pyspark.sql import functions as F

from tessera.operators import enrichment as E


def test_permutations_are_spread_and_right(spark):
    metric = spark.range(40).select(F.col("id").alias("gene"), (F.lit(20.5) - F.col("id")).alias("metric"))
    sets = spark.range(40).select(F.col("id").alias("gene"), (F.col("id") % 4 + F.when(F.col("id") < 8, 10).otherwise(0)).alias("term")).filter("gene % 3 > 0")
    got = {r["term"]: r for r in E.gsea(metric, sets, "gene", "term", permutations=60).collect()}
    import hashlib

    genes = list(range(40))
    value = {g: 20.5 - g for g in genes}
    terms = {}
    for r in sets.collect():
        terms.setdefault(r["term"], set()).add(r["gene"])

    def score(order, members):
        w = [abs(value[g]) for g in genes]  # weights belong to ranks
        total = sum(w[k] for k, g in enumerate(order) if g in members)
        high, low, hit, miss = -9.0, 9.0, 0.0, 0
        for k, g in enumerate(order):
            if g in members:
                low = min(low, hit / total - miss / (40 - len(members)))
                hit += w[k]
                high = max(high, hit / total - miss / (40 - len(members)))
            else:
                miss += 1
        return high if high >= -low else low

    for term, members in terms.items():
        real = score(genes, members)
        null = [score(sorted(genes, key=lambda g: (hashlib.md5(f"{g}|{p}|7".encode()).hexdigest(), g)), members) for p in range(1, 61)]
        same = [x for x in null if (x >= 0) == (real >= 0)]
        assert abs(got[term]["es"] - real) < 1e-9
        assert abs(got[term]["pval"] - sum(abs(x) >= abs(real) for x in same) / len(same)) < 1e-9
