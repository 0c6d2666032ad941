import corpus_pipeline
from quire.llm import quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(before)
            break
        assert out.columns == columns
        kept = {r.doc_id: r for r in out.collect()}
        assert all(before[i] == r for i, r in kept.items())
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
        elif name == "quality_classifier":
            want = {r.doc_id for r in quality.quality(docs, labels).collect() if r.predicted}
        elif name == "exact_dedup":
            last = {}
            for i, r in sorted(before.items()):
                last[(r.text or "").encode().translate(simhash.ASCII_LOWER)] = i
            want = set(last.values())
        else:
            fps = sorted((i, simhash.fingerprint(r.text)) for i, r in before.items())
            root = {i: i for i, _ in fps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for k, (i, a) in enumerate(fps):
                for j, b in fps[k + 1 :]:
                    if bin(a ^ b).count("1") <= 3:
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
            want = {i for i in root if find(i) == i}
        assert set(kept) == want, name
        docs = out.cache()
