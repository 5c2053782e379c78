"""Each stage of the corpus pipeline against brute force on its own input."""

import hashlib
import re

import corpus_pipeline
from cloakline.llm import toxicity
from cloakline.llm.common import written
from cloakline.session import read_table
from test_dedup import brute_near
from test_mix_warc_toxic import brute_mix

SF001 = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = read_table(spark, SF001, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near-dedup", "mixing", "packing"]
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], SF001), "stage"))
    rows = [[r for r in df.collect()] for df in made]
    ids = [sorted(r.doc_id for r in x) for x in rows]
    assert all(df.columns == docs.columns for df in made[:-1])
    texts = {r.doc_id: r for r in rows[0]}
    assert all(tuple(texts[r.doc_id]) == tuple(r) for x in rows[:-1] for r in x)

    model = toxicity.train(docs, read_table(spark, SF001, "labels"))
    severity = {r._row.doc_id: r.expected_severity for r in toxicity.graded(docs, model).collect()}
    assert ids[1] == sorted(i for i in ids[0] if severity[i] < toxicity.REJECT)

    first = {}
    for r in sorted(rows[1], key=lambda r: (-len(r.text or ""), r.doc_id)):
        first.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).digest(), r.doc_id)
    assert ids[2] == sorted(first.values())

    near = brute_near([(r.doc_id, r.text or "") for r in rows[2]], 5)
    assert ids[3] == sorted(i for i, x in near.items() if x[2])

    mix = brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in rows[3]], corpus_pipeline.MIX)
    assert ids[4] == sorted(i for i, _ in mix)

    assert sorted(r.doc_id for r in rows[5] if r.piece == 0) == ids[4]
    again = corpus_pipeline.run(spark, SF001).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(again) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows[5])
