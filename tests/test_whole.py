"""Registered queries over whole tables, counted without their own SQL."""

from tessera.plans import catalog


def test_ratio_discrepancies_lines(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_linenumber", "l_discount", "l_tax").collect()
    wanted = [r[0] for r in rows if abs(r[1] * 10 - r[2] * 10) > 0.05]
    found = [r["l_linenumber"] for r in catalog.queries()["ratio_discrepancies"](spark, folder).collect()]
    assert sorted(found) == sorted(wanted) and max(found) > 2


def test_leakage_counts_of_all_languages(spark, folder):
    chosen = catalog.queries()
    found, other = (chosen[x](spark, folder).first() for x in ("leakage_counts_of_pairs", "leakage_pair_counts"))
    assert tuple(found) == tuple(other) and found["pairs"] == chosen["exact_duplicate_pairs"](spark, folder).count()
