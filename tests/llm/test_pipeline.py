"""The pipeline's stages against plain Python on the small tables."""

import struct

import public_tokenizers

import corpus_pipeline
from inkproof.llm import bpe, decontaminate, pii
from tests.llm.test_minhash import plain_sets, roots


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append({r.doc_id: r for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    toxic, near, clean, private, tokens = frames
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    gone = [k for k in labels if k not in toxic]
    assert gone and sum(labels[k] for k in gone) >= 0.8 * len(gone)

    sets = plain_sets([(k, r.text) for k, r in toxic.items()])
    where = {}
    for key, grams in sets:
        for gram in grams:
            where.setdefault(gram, []).append(key)
    shared = {}
    for keys in where.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    size = {k: len(g) for k, g in sets}
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (size[a] + size[b] - n)]
    component = roots(size, links)
    assert set(near) == {k for k, c in component.items() if k == c}

    items = {r.item_id: decontaminate.words((r.text or "").encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    windows = {tuple(v[i : i + 10]) for v in items.values() for i in range(len(v) - 9)}
    assert set(clean) <= set(near)
    for key, row in near.items():
        words = decontaminate.words((row.text or "").encode())
        hit = {n for i in range(len(words) - 9) if tuple(words[i : i + 10]) in windows for n in range(i, i + 10)}
        assert (key in clean) == (len(hit) <= 0.5 * len(words))
        if key in clean and not hit:
            assert clean[key] == row
        elif key in clean:
            left = decontaminate.words((clean[key].text or "").encode())
            assert left == [w for n, w in enumerate(words) if n not in hit] and clean[key].n_chars == len(clean[key].text)

    assert set(private) == set(clean) == set(tokens)
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for key, row in private.items():
        assert row.text == pii.redact_text(clean[key].text) and row.n_chars == len(row.text)
        last = tokens[key]
        assert last.round_trip and last.n_tokens == len(last.ids) // 4
        assert b"".join(codec.token[i] for i, in struct.iter_unpack("<I", last.ids)).decode() == row.text


def test_run_and_empty(spark, tmp_path):
    names = "documents labels benchmark".split()
    for name in names:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
