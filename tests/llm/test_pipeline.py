import random

import corpus_pipeline
from loomspark.llm import neardup, pii
from tests.llm.data import SCHEMA
from tests.llm.test_texts import brute_near


def test_pipeline(spark, tmp_path):
    r = random.Random(12)
    plain = ["".join(r.choices("bcdfgaeiou", k=r.randint(4, 9))) for _ in range(400)]
    rows = [(i, " ".join([*r.choices(plain, k=80), *(["idiot", "idiot"] if i % 5 == 0 else [])])) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(1, 4)] + [(1100 + i, rows[i][1] + " tail") for i in range(6, 9)] + [(1200, rows[9][1] + " a.b@c.de")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"] and SCHEMA
    left = {i: t for i, t in rows if "idiot" not in t}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        if name == "exact_dedup":
            left = {i: t for i, t in left.items() if not 1000 <= i < 1100}
        if name == "near_dedup":
            left = {key: left[key] for key, _, c, kept in brute_near(list(left.items()), 5) if kept}
        if name == "pii":
            left = {i: pii.redacted(t, pii.all_spans(t, None, {})[1]) for i, t in left.items()}
        assert {x["doc_id"]: x["text"] for x in docs.collect()} == left, name
    assert all(x["n_chars"] == len(x["text"]) for x in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(left) and neardup.BANDS == 48
