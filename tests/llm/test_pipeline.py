import numpy as np

import corpus_pipeline as cp
from gneiss.llm.common import save


def test_stages_on_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50000, n)]
    passage, near = words(60), words(120)
    edited = list(near)
    edited[50] = "other"
    rows = [(i, " ".join(words(80))) for i in range(60)]
    rows += [(100 + i, " ".join([*words(30), "scum", *words(30), "idiot"])) for i in range(30)]  # toxic
    rows += [(200, "a  copy of\none text"), (201, "a copy of one text"), (300, " ".join(near)), (301, " ".join(edited))]
    rows += [(400, " ".join([*words(90), *passage])), (401, " ".join([*passage, *words(90)])), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in (*range(60), *range(100, 125))], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    d, left = spark.read.parquet(f"{sf}/documents.parquet"), {i for i, _ in rows}
    for (name, stage), gone in zip(cp.STAGES[:-1], ({i for i in left if 100 <= i < 130}, {201, 501}, {301}, set()), strict=True):
        d = save(stage(spark, d, sf), "test")
        left -= gone
        assert d.columns == docs.columns and {r["doc_id"] for r in d.collect()} == left, name
    after, before = {r["doc_id"]: r for r in d.collect()}, dict(rows)
    assert all(after[i]["text"] == before[i] for i in left - {401})
    assert after[401]["text"].split() == before[401].split()[60:] and after[401]["n_chars"] == len(after[401]["text"])
    assert {r["doc_id"] for r in cp.run(spark, sf).collect()} == left
