"""The stages one after another against plain Python."""

from collections import Counter

from brute import decontaminate, fingerprint, groups, measures
from odd_texts import SF

import corpus_pipeline as P
from hydrolens.llm.common import stored, table


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination",
                                        "mixing_to_targets", "sharding"]
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, sorted((r.doc_id, r.text) for r in docs.collect())
    docs = stored(P.quality_rules(spark, docs, SF), "t")
    rows = [r for r in rows if not measures(r[1])[-1]]
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    docs = stored(P.near_dedup(spark, docs, SF), "t")
    rows = [rows[i] for i, g in enumerate(groups([fingerprint(t) for _, t in rows])) if g == i]
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    docs = stored(P.decontamination(spark, docs, SF), "t")
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    rows = [r for r in rows if not decontaminate(r[1], items)[-1]]
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    docs = stored(P.mixing_to_targets(spark, docs, SF), "t")
    mixed = Counter((r.doc_id, r.text) for r in docs.collect())
    assert docs.columns == columns and set(mixed) <= set(rows) and 0.8 * len(rows) < sum(mixed.values()) < 1.2 * len(rows)
    out = P.shard(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in out) == mixed
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1


def test_run(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text", "lang"} <= set(out.columns)
    assert out.count() > 100
