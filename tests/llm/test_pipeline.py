"""The pipeline's stages against plain versions, each on its own input."""

import zlib

from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    import public_tokenizers as public
    import tiktoken

    import corpus_pipeline as p
    from codeloom.llm.bpe import read_ranks
    from codeloom.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in p.STAGES:
        out = stage(spark, seen[-1], SF)
        seen.append(written(out, "test"))
        if len(seen) <= len(p.STAGES):
            assert out.columns == docs.columns
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(q, d in rows[1]) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(bool(q) == kept for q, kept in held) / len(held) > 0.93
    near = brute.near([(d, r.text) for d, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {d for d, x in near.items() if x[2]}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.decontam([(d, r.text) for d, r in rows[2].items()], bench)
    assert set(rows[3]) == {d for d, x in hit.items() if not x[4]} and len(rows[3]) < len(rows[2])
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        assert not brute.secrets(r.text) and r.n_chars == len(r.text)
        if not brute.secrets(rows[3][d].text):
            assert r.text == rows[3][d].text
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {d: list(r.token_ids) for d, r in rows[5].items()} == {d: lib.encode_ordinary(r.text) for d, r in rows[4].items()}
    assert p.run(spark, SF).count() == len(rows[5])
