import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from findingflow.llm.near_dedup import inverse_frequencies, keep_one, vectors, weigh, weighted_jaccard
from findingflow.llm.pii import base_spans, redact_spans
from findingflow.llm.toxicity import score_toxicity

rng = random.Random(12)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(800)]


def prose(n):
    return rng.choices(VOCABULARY, k=n)


def write(spark, folder):
    items = [prose(n) for n in (8, 20, 60)]
    docs = [" ".join(prose(rng.randint(20, 150))) for _ in range(200)]
    docs += [" ".join([*prose(30), *rng.choices(["vile", "scum"], k=2), *prose(30)]) for _ in range(60)]
    docs += [" ".join(prose(40) + item + prose(40)) for item in items for _ in range(2)]
    docs += [d + " tail" for d in docs[:15]] + docs[20:30] + [None, "", "", "call +1 (504) 555-2652 or me@example.org, 4111 1111 1111 1111 now", " ".join(prose(6000))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)] + [(3, docs[3], "en", "s", 1), (None, "no id here", None, None, None), (None, "no id here", None, None, None)]
    labels = [(i, 1, int(200 <= i < 260)) for i in range(0, 260)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def plain(spark, folder):
    """What reaches packing: (doc_id, text), by the definitions."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    kept = docs.where(~docs.doc_id.isin(toxic) | docs.doc_id.isNull())
    rows = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in kept.collect()))
    idf = inverse_frequencies(kept, "text")
    made = [(lambda v: (v[0], weigh(v[0], v[1], idf)))(vectors([t])) for _, _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if rows[i][2] == rows[k][2] or weighted_jaccard(made[i], made[k]) >= 0.8:
                a, b = sorted((find(i), find(k)))
                root[b] = a
    first = [r for i, r in enumerate(rows) if find(i) == i]
    items = [set(zip(*[r.text.split()[k:] for k in range(5)])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r for r in first if not any(len(i & set(zip(*[r[2].split()[k:] for k in range(5)]))) >= 0.8 * len(i) for i in items)]
    return sorted((str(d), redact_spans(t, base_spans(t))) for _, d, t in clean), toxic


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder)
    want, toxic = plain(spark, folder)
    assert len(toxic & set(range(200, 260))) > 55 and not toxic - set(range(200, 260))
    assert any("[PHONE] or [EMAIL], [CARD] now" in t for _, t in want)
    got = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for d, text in want:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        pieces += [(d, at // 4096, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got) == sorted(pieces)


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
    once = keep_one(docs).collect()
    assert sum(r.doc_id == 3 for r in once) == 1 and sum(r.doc_id is None for r in once) == 1
