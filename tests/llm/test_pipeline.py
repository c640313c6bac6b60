import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece

import corpus_pipeline
from graphloom.llm.queries import QUERIES

WORDS = "the of and with thing there other water stone light river garden window letter morning paper".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose fate is known: (doc_id, text, the stage that drops it or None)."""
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)).capitalize() + "."
    item = line(40)
    rows, labels = [], []
    for k in range(0, 900):
        text, fate, quality, toxic = "\n".join(line(12) for _ in range(6)), None, 1, 0
        if k % 6 == 1:
            parts = text.split("\n")
            text, fate, toxic = "\n".join([*parts[:3], "such vilest scumbag drivel vilest.", *parts[3:]]), "toxicity", 1
        elif k % 6 == 2:
            text, fate, quality = " ".join([f"BUY!! NOW## N{rng.randint(0, 9)}$$"] * 60), "quality", 0
        rows.append((k, text, fate))
        labels.append((k, quality, toxic))
    clean = [r for r in rows if r[2] is None]
    rows += [(1000 + i, text, "near_duplicates") for i, (_, text, _) in enumerate(clean[:40])]
    rows += [(1100 + i, "\n".join(line(12) for _ in range(5)) + "\n" + (item if i % 2 else item.upper()), "decontamination") for i in range(20)]
    rows += [(1200, "\n".join(line(12) for _ in range(400)), None)]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(k, t, None if k % 7 else "en", None, None) for k, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {k: (t, f) for k, t, f in rows}


def test_each_stage_drops_its_own(spark, folder):
    path, fates = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = set(fates)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out.cache()
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept))
        left -= {k for k, (_, f) in fates.items() if f == name}
        assert len(left ^ set(kept)) <= 3, (name, sorted(left ^ set(kept)))


def test_run(spark, folder):
    path, fates = folder
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, path).collect()
    assert len({r.doc_id for r in rows} ^ {k for k, (_, f) in fates.items() if f is None}) <= 3
    for r in rows[:200]:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == library.encode(fates[r.doc_id][0], add_bos=True, add_eos=True) and r.text == fates[r.doc_id][0] and r.n_tokens == len(ids)


def test_odd_documents(spark, folder, odd, make):
    path, _ = folder
    for docs in (make(odd), make([])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() <= len(odd)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "pieces"]
